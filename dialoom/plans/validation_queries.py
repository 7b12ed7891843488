"""Validation of evaluation items: each pair of conversations is an item whose targets are a span of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evalset as K
from . import dialogue_queries
from .evaluation_queries import _SPANS, spans
from .registry import SQL, query, table
from .text_queries import CONTENT_SQL

_TEXTS = f"""{_SPANS}, sc AS (SELECT query_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM (SELECT DISTINCT sp.ep AS query_id, turn, text FROM sp JOIN conversations ON conv_id // 2 = sp.ep AND turn BETWEEN s AND e) GROUP BY query_id)"""
_ITEMS = f"""{_TEXTS}, it AS (SELECT conv_id // 2 AS id, min(text) AS question, concat('type', conv_id // 2 % 3) AS question_type, concat('style', conv_id // 2 % 2) AS style FROM conversations GROUP BY ALL),
cw AS (SELECT id, {CONTENT_SQL.format(x='question')} AS qw, {CONTENT_SQL.format(x='text')} AS tw FROM it JOIN sc ON query_id = id),
ov AS (SELECT id, CASE WHEN len(qw) > 0 AND len(tw) > 0 THEN len(list_intersect(qw, tw))::DOUBLE / len(qw) END AS overlap FROM cw),
bd AS (SELECT id, CASE WHEN overlap IS NULL THEN 'n/a' WHEN overlap < 1.0::DOUBLE / 3 THEN 'low' WHEN overlap < 2.0::DOUBLE / 3 THEN 'medium' ELSE 'high' END AS band FROM ov),
rare AS (SELECT word FROM (SELECT conv_id, unnest({CONTENT_SQL.format(x='text')}) AS word FROM conversations) GROUP BY word HAVING count(DISTINCT conv_id) <= 3),
sh AS (SELECT id, string_agg(word, ',' ORDER BY word) AS words FROM (SELECT id, unnest(list_intersect(qw, tw)) AS word FROM cw) WHERE word IN (SELECT word FROM rare) GROUP BY id),
own AS (SELECT ep AS id, string_agg(DISTINCT (span_id % 4)::VARCHAR, ',' ORDER BY (span_id % 4)::VARCHAR) AS seasons, CASE WHEN count(DISTINCT span_id % 2) > 1 THEN 'multi' ELSE 'single' END AS targets FROM sp GROUP BY ep)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select(F.col("ep").alias("query_id"), (F.col("span_id") % 2).alias("target"), (F.col("span_id") % 4).alias("season"), "ep", "start", "end")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(F.expr("conv_id div 2").alias("ep"), F.col("turn").alias("source_row"), F.col("text").alias("clean_text"))
    return K.scored_text(_targets(spark, sf_dir).select("query_id", "ep", "start", "end"), lines)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, question_type, style, text)"""
    asked = table(spark, sf_dir, "conversations").groupBy(F.expr("conv_id div 2").alias("id")).agg(F.min("text").alias("question"))
    kind = lambda name, n: F.concat(F.lit(name), (F.col("id") % n).cast("string")).alias(name)
    named = asked.select("id", "question", kind("type", 3).alias("question_type"), kind("style", 2))
    return named.join(_texts(spark, sf_dir).withColumnRenamed("query_id", "id"), "id")


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = K.rare_words(table(spark, sf_dir, "conversations"), "conv_id", "text")
    return K.shared_rare_words(_items(spark, sf_dir), "question", "text", rare)


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return K.item_strata(items, _targets(spark, sf_dir), K.lexical_overlap(items, "question", "text"))


@query("scored_text", f"WITH {_TEXTS} SELECT query_id, text FROM sc")
def scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir)


@query("shared_rare_words", f"WITH {_ITEMS} SELECT id, words FROM sh")
def shared_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).select("id", F.array_join("words", ",").alias("words"))


@query("item_strata", f"WITH {_ITEMS} SELECT id, question_type, style, seasons, targets, band AS overlap FROM it JOIN own USING (id) JOIN bd USING (id)")
def item_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).withColumn("seasons", F.array_join(F.transform("seasons", lambda s: s.cast("string")), ","))


@query(
    "distribution",
    f"""WITH {_ITEMS} SELECT 'question_type' AS measure, question_type AS value, count(*) AS n FROM it JOIN cw USING (id) GROUP BY ALL UNION ALL SELECT 'style', style, count(*) FROM it JOIN cw USING (id) GROUP BY ALL
UNION ALL SELECT 'season', (span_id % 4)::VARCHAR, count(DISTINCT ep) FROM sp GROUP BY ALL UNION ALL SELECT 'targets', k::VARCHAR, count(*) FROM (SELECT ep, count(*) AS k FROM sp GROUP BY ep) GROUP BY ALL
UNION ALL SELECT 'span_rows', (e - s + 1)::VARCHAR, count(*) FROM sp GROUP BY ALL""",
)
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.distribution(_strata(spark, sf_dir), _targets(spark, sf_dir))


@query(
    "overlap_report",
    f"""WITH {_ITEMS} SELECT question_type, count(*) FILTER (band = 'low') AS low, count(*) FILTER (band = 'medium') AS medium, count(*) FILTER (band = 'high') AS high, count(*) FILTER (band = 'n/a') AS n_a,
round(avg(CASE WHEN words IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hooked FROM it JOIN bd USING (id) LEFT JOIN sh USING (id) GROUP BY question_type""",
)
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = K.lexical_overlap(_items(spark, sf_dir), "question", "text").join(_shared(spark, sf_dir), "id", "left")
    return K.overlap_report(items.select("question_type", "overlap", F.size("words").alias("n_rare"))).withColumn("hooked", F.round("hooked", 6))


@query(
    "check_spans",
    f"""WITH st AS ({SQL["quote_status"]}), la AS (SELECT conv_id AS ep, max(turn) AS last FROM conversations GROUP BY conv_id),
ck AS (SELECT quote_id // 1000 AS query_id, quote_id % 1000 AS target, CASE WHEN quote_id % 7 > last THEN 'rows beyond the episode' WHEN status = 'missing' THEN 'quote not found' WHEN status = 'moved' THEN 'quote outside its rows' END AS problem FROM st JOIN la ON ep = quote_id // 1000)
SELECT query_id, target, problem FROM ck WHERE problem IS NOT NULL""",
)
def check_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = [F.expr("quote_id div 1000").alias("query_id"), (F.col("quote_id") % 1000).alias("target")]
    said, asked = dialogue_queries.quotes(spark, sf_dir)
    statuses = dialogue_queries.quote_status(spark, sf_dir).select(*key, "status")
    return K.check_spans(asked.select(*key, "ep", (F.col("quote_id") % 7).alias("end")), said.select("ep", "source_row"), statuses)
