"""Cleaning rules and text measures over lines that are made dirty on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lines as L
from .registry import query, table

#: Understood by Spark and DuckDB alike.
DIRTY = """CASE conv_id % 5
  WHEN 0 THEN concat('- ', text, '? - ', text, ' - ')
  WHEN 1 THEN concat('"  ', text, ' lf so BAlL.Then l saw ClTY  ', text)
  WHEN 2 THEN concat('-41 ', text, ' --')
  WHEN 3 THEN concat('“', text, '’’ NewYork… — ¡¦ ', text)
  ELSE concat('- -  ', text, '  y') END"""
DIRTY_SQL = f"SELECT conv_id, turn, role, {DIRTY} AS raw FROM conversations"

WORD, OTHER = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def _nested(x: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = "replace({}, '{}', '{}')".format(x, old.replace("'", "''"), new.replace("'", "''"))
    return x


def _tokens(x: str) -> str:
    for token, right in T.OCR_TOKENS:
        for _ in range(2):  # neighbours share the character between them
            x = rf"regexp_replace({x}, '(^|{OTHER}){token}({OTHER}|$)', '\1{right}\2', 'g')"
    return x


SQL_RULES = {
    "whitespace": lambda x: rf"trim(regexp_replace({x}, '[\s\v\x{{a0}}]+', ' ', 'g'))",
    "typography": lambda x: _nested(x, T.TYPOGRAPHY),
    "ocr_l_as_I": _tokens,
    "ocr_caps_l": lambda x: (
        rf"array_to_string(list_transform(regexp_extract_all({x}, '{WORD}+|{OTHER}'), lambda w: CASE WHEN regexp_full_match(w, '[A-Zl]{{3,}}') AND contains(w, 'l')"
        rf" AND regexp_matches(w, '[A-Z].*[A-Z]') THEN replace(w, 'l', 'I') ELSE w END), '')"
    ),
    "merged_words": lambda x: _nested(x, T.MERGED),
    "missing_space": lambda x: rf"regexp_replace({x}, '([a-z])([.?!])([A-Z][a-z])', '\1\2 \3', 'g')",
    "orphan_quote": lambda x: rf"regexp_replace({x}, '^\"\s+', '')",
    "leading_dash": lambda x: (
        rf"(CASE WHEN regexp_extract({x}, '^-[-\s]*') = '' OR regexp_extract({x}, '^-[-\s]*') = {x} OR (regexp_matches({x}, '^-[-]*[0-9]')) THEN {x} ELSE regexp_replace({x}, '^-[-\s]*', '') END)"
    ),
    "trailing_dash": lambda x: rf"regexp_replace({x}, '\s+-\s*$', '')",
}


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", f"{DIRTY} AS raw")


def _rule_query(name: str, rule) -> None:
    @query(f"text_{name}", f"SELECT conv_id, turn, {SQL_RULES[name]('raw')} AS clean FROM ({DIRTY_SQL})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dirty(spark, sf_dir).select("conv_id", "turn", rule(F.col("raw")).alias("clean"))


for _name, _rule in [*T.ROW_RULES, *T.TURN_RULES[:2]]:
    _rule_query(_name, _rule)


def _chain(source: str, column: str, names: list[str], tag: str) -> tuple[str, str]:
    """CTEs that apply rules one by one to ``column`` of ``source``; the last has the columns text and rules."""
    parts = [f"{tag}0 AS (SELECT *, {column} AS {tag}_t0 FROM {source})"]
    for i, n in enumerate(names):
        parts.append(f"{tag}{i + 1} AS (SELECT *, {SQL_RULES[n](f'{tag}_t{i}')} AS {tag}_t{i + 1} FROM {tag}{i})")
    used = ", ".join(f"CASE WHEN {tag}_t{i + 1} <> {tag}_t{i} THEN '{n}' END" for i, n in enumerate(names))
    k = len(names)
    parts.append(f"{tag} AS (SELECT * EXCLUDE ({', '.join(f'{tag}_t{i}' for i in range(k + 1))}), {tag}_t{k} AS {tag}_text, list_filter([{used}], lambda x: x IS NOT NULL) AS {tag}_rules FROM {tag}{k})")
    return ", ".join(parts), tag


_ROW, _ = _chain("dirty", "raw", [n for n, _ in T.ROW_RULES], "r")
_SPLIT = r"""string_split(regexp_replace(r_text, '([.?!"\-])\s+-\s*(\S)', concat('\1', chr(1), '\2'), 'g'), chr(1))"""
_TURN, _ = _chain("p", "piece", [n for n, _ in T.TURN_RULES], "u")
_TURNS = f"""WITH dirty AS ({DIRTY_SQL}), {_ROW},
p AS (SELECT conv_id, turn, r_rules, unnest({_SPLIT}) AS piece, unnest(generate_series(1, len({_SPLIT}))) AS i FROM r), {_TURN},
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS part, count(*) OVER (PARTITION BY conv_id, turn) AS n_parts
      FROM u WHERE regexp_matches(u_text, '[\\p{{L}}\\p{{N}}]')),
every AS (SELECT conv_id, turn, i, part, n_parts, u_text, list_concat(r_rules, list_filter(u_rules, lambda x: NOT list_contains(r_rules, x)), CASE WHEN n_parts > 1 THEN ['split_turns'] ELSE [] END) AS rules FROM k)
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir).select(F.struct("conv_id", "turn").alias("csv_record"), F.col("raw").alias("text_raw"))
    return L.turns(rows).select("csv_record", F.col("csv_record.conv_id").alias("conv_id"), F.col("csv_record.turn").alias("turn"), "part", "n_parts", "clean_text", "text_rules")


@query("split_turns", _TURNS + "SELECT conv_id, turn, part::BIGINT AS part, n_parts::BIGINT AS n_parts, u_text AS clean_text, array_to_string(rules, ',') AS rules FROM every")
def split_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.col("part").cast("long").alias("part"), F.col("n_parts").cast("long").alias("n_parts"), "clean_text", F.array_join("text_rules", ",").alias("rules"))


@query("rule_trace", _TURNS + "SELECT array_to_string(rules, ',') AS rules, count(*)::BIGINT AS n FROM every GROUP BY 1")
def rule_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).groupBy(F.array_join("text_rules", ",").alias("rules")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rule_summary",
    _TURNS + """, e AS (SELECT conv_id, turn, part, u_text, unnest(rules) AS rule FROM every),
x AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY conv_id, turn, part) AS rn FROM e)
SELECT rule, count(DISTINCT (conv_id, turn))::BIGINT AS n_rows, string_agg(CASE WHEN rn <= 3 THEN u_text END, '|' ORDER BY rn) AS examples FROM x GROUP BY rule""",
)
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rule_summary(_turns(spark, sf_dir)).select("rule", "n_rows", F.array_join("examples", "|").alias("examples"))


@query("split_summary", _TURNS + "SELECT count(DISTINCT (conv_id, turn))::BIGINT AS n_rows, count(*)::BIGINT AS n_lines FROM every WHERE n_parts > 1")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split_summary(_turns(spark, sf_dir))


@query("text_quote_form", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[''’.]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS form FROM documents")
def quote_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.match_form(F.col("text")).alias("form"))


@query(
    "token_counts",
    r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS search_tokens, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::BIGINT AS tokens FROM documents",
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.search_tokens(F.col("text"))).cast("long").alias("search_tokens"), T.count_tokens(F.col("text")).cast("long").alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
CONTENT_SQL = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x}), '[''’.]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND NOT list_contains([" + _STOP + "], w))))"


@query("content_words", f"SELECT item_id, array_to_string({CONTENT_SQL.format(x='text')}, ' ') AS words FROM benchmark")
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.content_words(F.col("text"))), " ").alias("words"))


@query("mentions", "SELECT doc_id, regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(the|von)([^\\p{L}\\p{N}_]|$)') AS named FROM documents")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.mentions(F.col("text"), "the", ("von",)).alias("named"))


@query("slugs", "SELECT page_id, regexp_replace(regexp_replace(lower(split_part(url, '/', -1)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("line_ids", "SELECT conv_id, turn, printf('s%02de%02d-r%03d-%d', conv_id % 7, conv_id, turn, 0) AS line_id, concat(CASE WHEN role = 'system' THEN '(unknown)' ELSE role END, ': ', text) AS shown FROM conversations")
def line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    speaker = F.when(F.col("role") != "system", F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.line_id(F.col("conv_id") % 7, F.col("conv_id"), F.col("turn"), F.lit(0)).alias("line_id"), T.shown_line(speaker, F.col("text")).alias("shown"))
