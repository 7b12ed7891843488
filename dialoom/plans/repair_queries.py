"""Row repair over events and conversations with gaps made on purpose; speaker labels with made variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import repair as B
from ..operators import speakers as S
from .registry import query, table

#: Blocks of 50 conversations stand for files; every 7th id loses a half or both.
_CSV = "conv_id * 100 + turn"
GAPS = f"""SELECT {_CSV} AS csv_record, conv_id // 50 AS block, CASE WHEN ({_CSV}) % 7 IN (0, 1) THEN NULL ELSE (conv_id // 10)::INT END AS season,
CASE WHEN ({_CSV}) % 7 IN (0, 2) THEN NULL ELSE (conv_id % 10)::INT END AS episode, CASE WHEN turn % 3 = 0 THEN '' ELSE turn::VARCHAR END AS index_field FROM conversations"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    csv = F.col("conv_id") * 100 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        csv.alias("csv_record"), F.expr("conv_id div 50").alias("block"), F.when((csv % 7).isin(0, 1), None).otherwise(F.expr("int(conv_id div 10)")).alias("season"),
        F.when((csv % 7).isin(0, 2), None).otherwise(F.expr("int(conv_id % 10)")).alias("episode"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("turn").cast("string")).alias("index_field"),
    )


_FILLED = f"""WITH g AS ({GAPS}), w AS (SELECT *, last_value(CASE WHEN season IS NOT NULL AND episode IS NOT NULL THEN {{'s': season, 'e': episode}} END IGNORE NULLS) OVER (PARTITION BY block ORDER BY csv_record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
 first_value(CASE WHEN season IS NOT NULL AND episode IS NOT NULL THEN {{'s': season, 'e': episode}} END IGNORE NULLS) OVER (PARTITION BY block ORDER BY csv_record ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM g),
f AS (SELECT csv_record, index_field, CASE WHEN season IS NOT NULL AND episode IS NOT NULL THEN 'kept' WHEN a = b AND coalesce(season, b.s) = b.s AND coalesce(episode, b.e) = b.e THEN 'filled' ELSE 'unresolved' END AS filled, season AS s0, episode AS e0, b FROM w),
r AS (SELECT csv_record, index_field, CASE WHEN filled = 'filled' THEN b.s ELSE s0 END AS season, CASE WHEN filled = 'filled' THEN b.e ELSE e0 END AS episode, filled FROM f)
"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fill_ids(gaps(spark, sf_dir), block=["block"])


@query("fill_missing_ids", _FILLED + "SELECT csv_record, season, episode, filled FROM r")
def fill_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).select("csv_record", "season", "episode", "filled")


@query(
    "assign_source_rows",
    _FILLED + "SELECT csv_record, CASE WHEN regexp_full_match(index_field, '[0-9]+') THEN index_field::INT ELSE (csv_record - min(csv_record) OVER (PARTITION BY season, episode))::INT END AS source_row, NOT regexp_full_match(index_field, '[0-9]+') AS reconstructed FROM r WHERE filled <> 'unresolved'",
)
def assign_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.source_rows(_filled(spark, sf_dir).filter("filled <> 'unresolved'")).select("csv_record", "source_row", "reconstructed")


@query("order_anomalies", "SELECT event_id, user_id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE value <= previous")
def order_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.order_anomalies(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value").select("event_id", "user_id", "value", "previous")


@query(
    "reopened_blocks",
    """SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS b, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) WHERE p > 1 AND b <> event_type""",
)
def reopened_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("block", F.expr("event_id div 1000"))
    return B.reopened(e, ["event_type"], "event_id", ["block"]).select("event_id", "event_type")


@query(
    "number_ranges",
    """SELECT user_id, min(event_id) AS first, max(event_id) AS last, CASE WHEN min(event_id) = max(event_id) THEN min(event_id)::VARCHAR ELSE min(event_id) || '-' || max(event_id) END AS label
FROM (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM (SELECT DISTINCT user_id, event_id FROM events WHERE event_type <> 'click')) GROUP BY user_id, i""",
)
def number_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ranges(table(spark, sf_dir, "events").filter("event_type <> 'click'"), ["user_id"], "event_id").select("user_id", "first", "last", "label")


@query("number_cast", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE trunc(value)::INT END AS n, event_id % 5 = 1 AS bad FROM events")
def number_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "  ").when(F.col("event_id") % 5 == 1, "nan").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", B.number(raw).alias("n"), B.bad_number(raw).alias("bad"))


LABELS = """CASE conv_id % 6 WHEN 0 THEN concat('(', upper(substr(role, 1, 1)), substr(role, 2), ')') WHEN 1 THEN concat(role, ' #', turn % 3) WHEN 2 THEN concat(role, ' and  Guest & ', role)
WHEN 3 THEN concat(upper(substr(role, 1, 2)), substr(role, 3)) WHEN 4 THEN '  ' ELSE concat(' ', role, ', Bob') END"""
_TIDY = r"regexp_replace(trim(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '^\((.*)\)$', '\1')), '^(.*?[A-Za-z])\s*#?\s*(\d+)$', '\1 \2')"
_LABELS = f"l AS (SELECT conv_id, turn, {LABELS} AS raw FROM conversations), t AS (SELECT *, {_TIDY.format(x='raw')} AS tidy FROM l), "
_NAMES = _LABELS + rf"""n0 AS (SELECT conv_id, turn, unnest(p) AS part, unnest(generate_series(1, len(p))) AS i FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(tidy, '\s*(?:,|&|\band\b)\s*'), lambda x: x <> '') AS p FROM t)),
n AS (SELECT conv_id, turn, i, {_TIDY.format(x='part')} AS name FROM n0), c AS (SELECT name, count(*) AS n FROM n GROUP BY name),
e AS (SELECT name, n, list_sum(list_transform(regexp_extract_all(name, '[A-Za-z]+'), lambda w: (CASE WHEN regexp_matches(w, '^[a-z]') THEN 1 ELSE 0 END) + length(regexp_replace(substr(w, 2), '[^A-Z]', '', 'g')))) AS errors FROM c),
m AS (SELECT name AS variant, best FROM (SELECT name, first_value(name) OVER (PARTITION BY lower(name) ORDER BY errors, n DESC, name) AS best FROM e) WHERE name <> best),
scoped AS (SELECT 3 AS s, 'Guest' AS f, 'Visitor' AS o), everywhere AS (SELECT 'Guest' AS f, 'Stranger' AS o UNION ALL SELECT 'Bob', 'Robert'),
res AS (SELECT n.conv_id, n.turn, n.i, n.name, coalesce(scoped.o, everywhere.o, m.best, n.name) AS resolved FROM n LEFT JOIN m ON n.name = m.variant LEFT JOIN scoped ON n.conv_id % 10 = scoped.s AND coalesce(m.best, n.name) = scoped.f LEFT JOIN everywhere ON coalesce(m.best, n.name) = everywhere.f)
"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "struct(conv_id, turn) AS csv_record", "int(conv_id % 10) AS season", "1 AS episode", f"{LABELS} AS speaker_raw")


def aliases(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    scoped = spark.createDataFrame([(3, 1, "Guest", "Visitor")], "season int, episode int, from_name string, to_name string")
    return scoped, spark.createDataFrame([("Guest", "Stranger"), ("Bob", "Robert")], "from_name string, to_name string")


@query("speaker_tidy", f"WITH {_LABELS} z AS (SELECT 1) SELECT conv_id, turn, tidy FROM t")
def speaker_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("conv_id", "turn", S.tidy_label(F.col("speaker_raw"))["text"].alias("tidy"))


@query("speaker_counts", f"WITH {_NAMES} SELECT name, n, errors::BIGINT AS errors FROM e")
def speaker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.label_counts(labels(spark, sf_dir)).select("name", "n", S.casing_errors(F.col("name")).cast("long").alias("errors"))


@query("case_map", f"WITH {_NAMES} SELECT variant, best FROM m")
def case_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.case_map(S.label_counts(labels(spark, sf_dir)))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir)
    return S.normalize_speakers(rows, "csv_record", S.case_map(S.label_counts(rows)), *aliases(spark))


@query("alias_resolve", f"WITH {_NAMES} SELECT resolved, count(*) AS n FROM res GROUP BY resolved")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir)
    parts = rows.select("season", "episode", F.explode(S.split_label(S.tidy_label(F.col("speaker_raw"))["text"])).alias("part")).withColumn("name", S.tidy_label(F.col("part"))["text"])
    return S.resolve(parts, S.case_map(S.label_counts(rows)), *aliases(spark)).groupBy("resolved").agg(F.count(F.lit(1)).alias("n"))


@query(
    "multi_speaker",
    f"""WITH {_NAMES} , d AS (SELECT conv_id, turn, resolved, min(i) AS i FROM res GROUP BY ALL)
SELECT c.conv_id, c.turn, string_agg(resolved, ' & ' ORDER BY i) AS speaker, count(resolved) AS n FROM conversations c LEFT JOIN d ON c.conv_id = d.conv_id AND c.turn = d.turn GROUP BY c.conv_id, c.turn""",
)
def multi_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers(spark, sf_dir).select("csv_record.conv_id", "csv_record.turn", "speaker", F.size("speakers").cast("long").alias("n"))


@query(
    "top_speakers",
    f"WITH {_NAMES} , d AS (SELECT DISTINCT conv_id, turn, resolved FROM res) SELECT resolved AS speaker, count(*) AS n, min(conv_id * 100 + turn) AS first FROM d GROUP BY 1 ORDER BY n DESC, first LIMIT 5",
)
def top_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = speakers(spark, sf_dir).withColumn("line_no", F.col("csv_record.conv_id") * 100 + F.col("csv_record.turn"))
    return L.top_speakers(lines, 5)


@query("lines_per_group", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def lines_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.group_counts(table(spark, sf_dir, "conversations"), "conv_id")


@query("lines_per_group_stats", "SELECT min(n) AS least, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS most FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def lines_per_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.count_spread(L.group_counts(table(spark, sf_dir, "conversations"), "conv_id"))


@query("titles_left_join", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def titles_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")
