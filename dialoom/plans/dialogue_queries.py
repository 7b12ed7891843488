"""Scenes, chunks and quotes: conversations stand for episodes, lines of documents for longer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TRANSITIONS, Scenes
from ..functions.text import count_tokens
from ..operators import chunking as G
from ..operators import provenance as I
from ..operators import scenes as S
from .registry import query, table

#: Conversations in runs of five, so that an episode has enough lines for scenes; names vary by conversation.
_EP, _NAME = "conv_id // 5", "concat(role, conv_id % 3)"
LINES = f"""l AS (SELECT conv_id // 5 AS ep, row_number() OVER (PARTITION BY conv_id // 5 ORDER BY conv_id, turn) - 1 AS i, concat(role, conv_id % 3) AS name,
CASE WHEN turn = 0 AND conv_id % 4 = 0 THEN concat('Later that day ', text) ELSE text END AS clean_text FROM conversations)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations").withColumn("ep", F.expr("conv_id div 5"))
    i = F.row_number().over(Window.partitionBy("ep").orderBy("conv_id", "turn")) - 1
    text = F.when((F.col("turn") == 0) & (F.col("conv_id") % 4 == 0), F.concat(F.lit("Later that day "), F.col("text"))).otherwise(F.col("text"))
    name = F.concat("role", (F.col("conv_id") % 3).cast("string"))
    return c.select("ep", i.cast("long").alias("i"), name.alias("speaker"), F.array(name).alias("speakers"), text.alias("clean_text"), i.cast("long").alias("source_row"))


SIMILAR = (
    LINES
    + """, w AS (SELECT ep, name, ln(sum(count(*)) OVER (PARTITION BY ep) / count(*)) AS w FROM l GROUP BY ep, name),
side AS (SELECT ep, i, list(name) OVER (PARTITION BY ep ORDER BY i ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS a, list(name) OVER (PARTITION BY ep ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS b FROM l),
ab AS (SELECT ep, i, unnest(list_distinct(list_concat(a, b))) AS name, a, b FROM side WHERE i > 0),
sim AS (SELECT ep, i, CASE WHEN sum(w) = 0 THEN 1.0 ELSE sum(CASE WHEN list_contains(a, name) AND list_contains(b, name) THEN w ELSE 0 END) / sum(w) END AS s FROM ab JOIN w USING (ep, name) GROUP BY ep, i)"""
)


@query("scene_similarity", f"WITH {SIMILAR} SELECT l.ep, l.i, round(s, 6) AS similarity FROM l LEFT JOIN sim USING (ep, i)")
def scene_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.similarities(lines(spark, sf_dir)).select("ep", "i", F.round("similarity", 6).alias("similarity"))


_CAND = SIMILAR + f""", nb AS (SELECT ep, i, round(s, 9) AS s, coalesce(round(lag(s) OVER (PARTITION BY ep ORDER BY i), 9), 9) AS p, coalesce(round(lead(s) OVER (PARTITION BY ep ORDER BY i), 9), 9) AS n FROM (SELECT l.ep, l.i, s FROM l LEFT JOIN sim USING (ep, i))),
k AS (SELECT ep, i, 1.25 - s AS strength, 'speaker_turnover' AS sig FROM nb WHERE s <= 0.25 AND s <= p AND s <= n UNION ALL SELECT ep, i, 2.0, 'transition_phrase' FROM l WHERE i > 0 AND regexp_matches(clean_text, '(?i){TRANSITIONS}')),
cand AS (SELECT ep, i, sum(strength)::DOUBLE AS strength, string_agg(sig, ',' ORDER BY sig) AS signals FROM k GROUP BY ep, i)"""


@query("scene_candidates", f"WITH {_CAND} SELECT ep, i, round(strength, 6) AS strength, signals FROM cand")
def scene_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = F.floor(F.col("strength") * 1e6 + 0.5) / 1e6  # halves of the binary product, as the SQL has them; F.round takes those of the printed number
    return S.candidates(lines(spark, sf_dir)).select("ep", "i", six.alias("strength"), F.array_join("signals", ",").alias("signals"))


@query("transition_lines", f"WITH {LINES} SELECT ep, i FROM l WHERE i > 0 AND regexp_matches(clean_text, '(?i){TRANSITIONS}')")
def transition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter((F.col("i") > 0) & F.col("clean_text").rlike("(?i)" + TRANSITIONS)).select("ep", "i")


_GREEDY = _CAND.replace("WITH ", "") + """, sizes AS (SELECT ep, count(*) AS n FROM l GROUP BY ep),
o AS (SELECT c.ep, i, row_number() OVER (PARTITION BY c.ep ORDER BY round(strength, 9) DESC, i) AS rn FROM cand c JOIN sizes USING (ep) WHERE i >= 6 AND i <= n - 6),
g AS (SELECT ep, 0::BIGINT AS rn, []::BIGINT[] AS chosen FROM sizes UNION ALL
 SELECT g.ep, o.rn, CASE WHEN len(list_filter(g.chosen, lambda x: abs(x - o.i) < 6)) = 0 THEN list_append(g.chosen, o.i) ELSE g.chosen END FROM g JOIN o ON o.ep = g.ep AND o.rn = g.rn + 1),
cut AS (SELECT ep, unnest(chosen) AS i FROM (SELECT ep, chosen FROM g QUALIFY row_number() OVER (PARTITION BY ep ORDER BY rn DESC) = 1))"""


@query("scene_boundaries", f"WITH RECURSIVE {_GREEDY} SELECT ep, i FROM cut")
def scene_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.boundaries(lines(spark, sf_dir))


@query(
    "scenes",
    f"""WITH RECURSIVE {_GREEDY}, num AS (SELECT l.ep, l.i, 1 + count(cut.i) OVER (PARTITION BY l.ep ORDER BY l.i) AS scene FROM l LEFT JOIN cut ON cut.ep = l.ep AND cut.i = l.i)
SELECT ep, scene, min(i) AS line_start, max(i) + 1 AS line_end, count(*) AS n_lines FROM num GROUP BY ep, scene""",
)
def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scenes(lines(spark, sf_dir), Scenes()).select("ep", "scene", "line_start", "line_end", "n_lines")


#: Lines of documents; a line's tokens are its words and punctuation marks.
DOC_LINES = r"""dl AS (SELECT doc_id AS ep, i - 1 AS i, x AS clean_text, lang, len(regexp_extract_all(x, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS tokens
FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ep"), "lang", F.posexplode(F.split("text", "\n")).alias("i", "clean_text"))
    return cut.select("ep", F.col("i").cast("long").alias("i"), "clean_text", count_tokens(F.col("clean_text")).cast("long").alias("tokens"), F.col("lang").alias("speaker"), F.array("lang").alias("speakers"), F.col("i").cast("long").alias("source_row"))


def pack_sql(size: int, overlap: int) -> str:
    """Windows by recursion over prefix sums: cum[j + 1] is the sum of the first j counts."""
    return (
        DOC_LINES
        + f""", cs AS (SELECT ep, list(tokens ORDER BY i) AS n, list_prepend(0, list(cum ORDER BY i)) AS cum FROM (SELECT ep, i, tokens, sum(tokens) OVER (PARTITION BY ep ORDER BY i)::BIGINT AS cum FROM dl) GROUP BY ep),
win AS (SELECT ep, n, cum, 0::BIGINT AS chunk, 0::BIGINT AS s, greatest(1, len(list_filter(cum, lambda c: c <= {size})) - 1)::BIGINT AS e FROM cs
UNION ALL SELECT ep, n, cum, chunk + 1, t, greatest(t + 1, len(list_filter(cum, lambda c: c <= cum[t + 1] + {size})) - 1)::BIGINT FROM (
 SELECT ep, n, cum, chunk, least(e, greatest(s + 1, len(list_filter(cum, lambda c: cum[e + 1] - c > least({overlap}, {size} - n[e + 1])))))::BIGINT AS t FROM win WHERE e < len(n)))"""
    )


def _pack_query(size: int, overlap: int) -> None:
    @query(f"chunk_pack_{size}_{overlap}", f"WITH RECURSIVE {pack_sql(size, overlap)} SELECT ep, chunk, s AS start, e AS stop FROM win")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = F.transform(F.split("text", "\n"), lambda line: count_tokens(line))
        return G.windows_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ep"), counts.alias("counts")), [(size, overlap)]).select("ep", "chunk", "start", "stop")


_pack_query(64, 8)
_pack_query(128, 16)


@query(
    "chunk_neighbors",
    f"""WITH RECURSIVE {pack_sql(128, 16)}, m AS (SELECT w.ep, chunk, sum(tokens)::BIGINT AS n_tokens, count(*) AS n_lines, string_agg(concat(lang, ': ', clean_text), chr(10) ORDER BY i) AS text FROM win w JOIN dl ON dl.ep = w.ep AND i >= s AND i < e GROUP BY w.ep, chunk)
SELECT printf('%d-tok128o16-%03d', ep, chunk) AS chunk_id, n_tokens, n_lines, md5(text) AS text_md5, printf('%d-tok128o16-%03d', ep, lag(chunk) OVER (PARTITION BY ep ORDER BY chunk)) AS prev_chunk_id, printf('%d-tok128o16-%03d', ep, lead(chunk) OVER (PARTITION BY ep ORDER BY chunk)) AS next_chunk_id FROM m""",
)
def chunk_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = G.chunks(doc_lines(spark, sf_dir), [(128, 16)])
    return made.select("chunk_id", "n_tokens", "n_lines", F.md5("text").alias("text_md5"), "prev_chunk_id", "next_chunk_id")


@query(
    "chunk_size_stats",
    f"""WITH RECURSIVE {pack_sql(128, 16)}, m AS (SELECT w.ep, chunk, sum(tokens)::BIGINT AS v FROM win w JOIN dl ON dl.ep = w.ep AND i >= s AND i < e GROUP BY w.ep, chunk), a AS (SELECT list(v ORDER BY v) AS x FROM m)
SELECT x[1] AS least, x[least(len(x) - 1, floor(0.1 * len(x))::BIGINT) + 1] AS p10, x[least(len(x) - 1, floor(0.5 * len(x))::BIGINT) + 1] AS median, x[least(len(x) - 1, floor(0.9 * len(x))::BIGINT) + 1] AS p90, x[len(x)] AS most FROM a""",
)
def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = G.chunks(doc_lines(spark, sf_dir), [(128, 16)]).select("size", F.col("n_tokens").alias("v"))
    return G.spread(sizes, ["size"], "v").drop("size")


#: Quotes: 20 characters of every turn, sought in the whole conversation.
_FORM = "trim(regexp_replace(regexp_replace(lower({x}), '[''’.]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_QUOTES = f"""f AS (SELECT conv_id AS ep, turn, {_FORM.format(x='text')} AS f FROM conversations), placed AS (SELECT ep, turn, f, coalesce(sum(length(f) + 1) OVER (PARTITION BY ep ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM f),
ep AS (SELECT ep, string_agg(f, ' ' ORDER BY turn) AS t FROM f GROUP BY ep), q AS (SELECT conv_id * 1000 + turn AS quote_id, conv_id AS ep, turn, {_FORM.format(x='substr(text, 10, 20)')} AS needle FROM conversations),
pos AS (SELECT quote_id, ep.ep, unnest(list_filter(range(0, greatest(length(t) - length(needle) + 1, 0)), lambda p: substr(t, p + 1, length(needle)) = needle)) AS p, length(needle) AS n FROM q JOIN ep ON ep.ep = q.ep WHERE needle <> ''),
hit AS (SELECT quote_id, (SELECT max(turn) FROM placed WHERE placed.ep = pos.ep AND a <= p) AS row_first, (SELECT max(turn) FROM placed WHERE placed.ep = pos.ep AND a <= p + n - 1) AS row_last FROM pos)"""


def quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    asked = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("quote_id"), F.col("conv_id").alias("ep"), F.substring("text", 10, 20).alias("quote"))
    said = c.select(F.col("conv_id").alias("ep"), F.col("turn").alias("i"), F.col("turn").alias("source_row"), F.col("text").alias("clean_text"))
    return said, asked


@query("find_quote", f"WITH {_QUOTES} SELECT quote_id, row_first, row_last FROM hit")
def find_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.find_quotes(*quotes(spark, sf_dir)).select("quote_id", "row_first", "row_last")


@query(
    "quote_status",
    f"""WITH {_QUOTES} SELECT quote_id, CASE WHEN quote_id % 3 = 0 THEN 'no_quote' WHEN bool_or(row_first >= s AND row_last <= s) THEN 'ok' WHEN count(row_first) > 0 THEN 'moved' ELSE 'missing' END AS status
FROM (SELECT q.quote_id, q.quote_id % 7 AS s, row_first, row_last FROM q LEFT JOIN hit ON hit.quote_id = q.quote_id) GROUP BY quote_id""",
)
def quote_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, asked = quotes(spark, sf_dir)
    spans = asked.select("quote_id", "ep", (F.col("quote_id") % 7).alias("start"), (F.col("quote_id") % 7).alias("end"), F.when(F.col("quote_id") % 3 != 0, F.col("quote")).otherwise("").alias("quote"))
    return I.quote_status(spans, I.find_quotes(said, spans.select("quote_id", "ep", "quote")))
