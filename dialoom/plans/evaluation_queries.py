"""Relevance, metrics, comparisons, validation and checks over vectors, documents and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evalset as K
from ..operators import metrics as J
from ..operators import provenance as I
from ..operators import retrieval as R
from .registry import query, table
from .retrieval_queries import DENSE, asked_vectors, ranked_sql, vectors
from .text_queries import CONTENT_SQL

#: Spans and chunks of conversations: a span of up to three rows for each conversation, chunks of two rows.
_SPANS = "sp AS (SELECT conv_id AS span_id, conv_id // 2 AS ep, min(turn) AS s, least(min(turn) + conv_id % 3, max(turn)) AS e FROM conversations GROUP BY conv_id)"
_CHUNKS = "ch AS (SELECT conv_id AS chunk_conv, conv_id // 2 AS ep, turn AS cs, turn + 1 AS ce FROM conversations WHERE turn % 2 = 0)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    return c.select(F.col("conv_id").alias("span_id"), F.expr("conv_id div 2").alias("ep"), F.col("a").alias("start"), F.least(F.col("a") + F.col("conv_id") % 3, F.col("b")).alias("end"))


@query("span_relevance", f"WITH {_SPANS}, {_CHUNKS} SELECT span_id, chunk_conv, cs AS source_row_start FROM sp JOIN ch USING (ep) WHERE s <= ce AND cs <= e")
def span_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").filter("turn % 2 = 0").select(F.col("conv_id").alias("chunk_conv"), F.expr("conv_id div 2").alias("ep"), F.col("turn").alias("source_row_start"), (F.col("turn") + 1).alias("source_row_end"))
    return I.span_hits(spans(spark, sf_dir), chunks).select("span_id", "chunk_conv", "source_row_start")


@query("span_lines", f"WITH {_SPANS} SELECT span_id, conv_id, turn, printf('S%02dE%02d rows %d-%d', 1, ep, s, e) AS label FROM sp JOIN conversations ON conv_id // 2 = ep AND turn BETWEEN s AND e")
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("conv_id div 2").alias("ep"), F.col("turn").alias("source_row_start"), F.col("turn").alias("source_row_end"))
    return I.span_hits(spans(spark, sf_dir), lines).select("span_id", "conv_id", "turn", I.span_label(F.lit(1), F.col("ep"), F.col("start"), F.col("end")).alias("label"))


@query("overlapping_targets", f"WITH {_SPANS} SELECT DISTINCT a.span_id AS a, b.span_id AS b FROM sp a JOIN sp b ON a.ep = b.ep AND a.span_id < b.span_id AND a.s <= b.e AND b.s <= a.e")
def overlapping_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.overlapping_targets(spans(spark, sf_dir).withColumnRenamed("span_id", "query_id"))


#: Dense rankings of depth 50; a vector is relevant if its label is the query's (target 0) or the next one (target 1).
_RANKED = f"{DENSE}, rk AS ({ranked_sql('dense', 50, 'query_id <> chunk_id')}), ql AS (SELECT chunk_id AS query_id, label AS ql FROM v), hits AS (SELECT query_id, rank, CASE WHEN label = ql THEN 0 ELSE 1 END AS target FROM rk JOIN v USING (chunk_id) JOIN ql USING (query_id) WHERE label = ql OR label = (ql + 1) % 10)"


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, asked = vectors(spark, sf_dir), asked_vectors(spark, sf_dir)
    scored = R.dense_scores(v.select("chunk_id", "vector"), asked, 50, others=True)
    own = v.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("ql"))
    met = R.top_k(scored, 50).join(v.select("chunk_id", "label"), "chunk_id").join(own, "query_id")
    hits = met.filter((F.col("label") == F.col("ql")) | (F.col("label") == (F.col("ql") + 1) % 10)).select("query_id", "rank", F.when(F.col("label") == F.col("ql"), 0).otherwise(1).alias("target"))
    return hits, asked.select("query_id")


def _requirements(queries: DataFrame) -> DataFrame:
    """Even queries need both targets, odd hundreds any of them."""
    each = queries.select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("target"))
    return each.withColumn("requirement", F.when(F.col("query_id") % 100 == 0, F.col("target")).otherwise(0))


_REQ = _RANKED + """, rq AS (SELECT query_id, t AS target, CASE WHEN query_id % 100 = 0 THEN t ELSE 0 END AS requirement FROM (SELECT vec_id AS query_id, unnest([0, 1]) AS t FROM embeddings WHERE vec_id % 50 = 0)),
best AS (SELECT query_id, requirement, min(rank) AS r FROM rq LEFT JOIN hits USING (query_id, target) GROUP BY ALL),
m AS (SELECT query_id, count(*) AS n_requirements, min(CASE WHEN r <= 10 THEN r END) AS first_relevant_rank, min(r) AS first_relevant_rank_in_depth, coalesce(1.0 / min(CASE WHEN r <= 10 THEN r END), 0) AS rr,
 max((coalesce(r, 99) <= 1)::INT)::DOUBLE AS hit_1, max((coalesce(r, 99) <= 5)::INT)::DOUBLE AS hit_5, max((coalesce(r, 99) <= 10)::INT)::DOUBLE AS hit_10, avg((coalesce(r, 99) <= 1)::INT) AS recall_1, avg((coalesce(r, 99) <= 5)::INT) AS recall_5, avg((coalesce(r, 99) <= 10)::INT) AS recall_10,
 CASE WHEN count(*) > 1 THEN min((coalesce(r, 99) <= 5)::INT)::DOUBLE END AS all_5, CASE WHEN count(*) > 1 THEN min((coalesce(r, 99) <= 10)::INT)::DOUBLE END AS all_10 FROM best GROUP BY query_id)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, asked = _hits(spark, sf_dir)
    rows = J.score_rankings(hits, _requirements(asked))
    return rows.select("query_id", "n_requirements", F.col("first_relevant_rank").cast("long").alias("first_relevant_rank"), F.col("first_relevant_rank_in_depth").cast("long").alias("first_relevant_rank_in_depth"), *[c for c in rows.columns if c not in ("query_id", "n_requirements", "first_relevant_rank", "first_relevant_rank_in_depth")])


@query("hit_recall_mrr", f"WITH {_REQ} SELECT query_id, n_requirements, first_relevant_rank, first_relevant_rank_in_depth, round(rr, 6) AS rr, hit_1, hit_5, hit_10, recall_1, recall_5, recall_10 FROM m")
def hit_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).drop("all_5", "all_10").withColumn("rr", F.round("rr", 6))


@query("all_targets_hit", f"WITH {_REQ} SELECT query_id, all_5, all_10 FROM m")
def all_targets_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "all_5", "all_10")


@query("multi_target_partial", f"WITH {_REQ} SELECT query_id FROM m WHERE hit_5 = 1 AND recall_5 < 1")
def multi_target_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.partial_hits(_scored(spark, sf_dir), 5)


@query(
    "target_first_ranks",
    f"WITH {_REQ} SELECT query_id, string_agg(coalesce(r::VARCHAR, '-'), ',' ORDER BY target) AS ranks FROM (SELECT query_id, target, min(rank) AS r FROM rq LEFT JOIN hits USING (query_id, target) GROUP BY ALL) GROUP BY query_id",
)
def target_first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, asked = _hits(spark, sf_dir)
    found = J.target_first_ranks(hits, _requirements(asked))
    return found.select("query_id", F.array_join(F.transform("ranks", lambda r: F.coalesce(r.cast("string"), F.lit("-"))), ",").alias("ranks"))


@query(
    "average_by_type",
    f"""WITH {_REQ}, t AS (SELECT m.*, CASE WHEN query_id % 150 = 0 THEN NULL ELSE concat('type', query_id % 3) END AS kind FROM m)
SELECT NULL AS kind, round(avg(rr), 6) AS rr, round(avg(recall_5), 6) AS recall_5, round(avg(all_5), 6) AS all_5, count(*) AS n FROM t
UNION ALL SELECT kind, round(avg(rr), 6), round(avg(recall_5), 6), round(avg(all_5), 6), count(*) FROM t WHERE kind IS NOT NULL GROUP BY kind""",
)
def average_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("query_id") % 150 != 0, F.concat(F.lit("type"), (F.col("query_id") % 3).cast("string")))
    return J.averages(_scored(spark, sf_dir).withColumn("kind", kind), ["rr", "recall_5", "all_5"], 6, "kind").select("kind", "rr", "recall_5", "all_5", "n")


#: Cells made from hashes: hit and first rank by query, method and size.
_CELLS = """cells AS (SELECT item_id AS query_id, m AS method, s AS size, ('0x' || substr(md5(concat(item_id, m, s)), 1, 6))::INT % 12 + 1 AS rank
FROM benchmark, (SELECT unnest(['bm25', 'dense', 'hybrid']) AS m), (SELECT unnest([256, 512, 1024]) AS s)), h AS (SELECT *, rank <= 5 AS hit FROM cells)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    each = items.withColumn("method", F.explode(F.array(*map(F.lit, ("bm25", "dense", "hybrid"))))).withColumn("size", F.explode(F.array(*map(F.lit, (256, 512, 1024)))))
    rank = F.conv(F.substring(F.md5(F.concat(F.col("query_id").cast("string"), "method", F.col("size").cast("string"))), 1, 6), 16, 10).cast("int") % 12 + 1
    return each.withColumn("rank", rank).withColumn("hit", F.col("rank") <= 5)


@query(
    "outcome_buckets",
    f"""WITH {_CELLS}, w AS (SELECT query_id, bool_or(hit AND method = 'bm25') AS b, bool_or(hit AND method = 'dense') AS d, bool_or(hit AND method = 'hybrid') AS h FROM h WHERE size = 512 GROUP BY query_id)
SELECT query_id, 'both_hit' AS bucket FROM w WHERE b AND d UNION ALL SELECT query_id, 'bm25_only' FROM w WHERE b AND NOT d UNION ALL SELECT query_id, 'dense_only' FROM w WHERE d AND NOT b
UNION ALL SELECT query_id, 'both_missed' FROM w WHERE NOT b AND NOT d UNION ALL SELECT query_id, 'hybrid_recovery' FROM w WHERE h AND NOT b AND NOT d UNION ALL SELECT query_id, 'hybrid_regression' FROM w WHERE NOT h AND (b OR d)""",
)
def outcome_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.outcome_buckets(cells(spark, sf_dir).filter("size = 512"))


@query("size_sensitive", f"WITH {_CELLS} SELECT method, query_id FROM h GROUP BY ALL HAVING count(DISTINCT hit) > 1")
def size_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.size_sensitive(cells(spark, sf_dir))


@query("rank_changes", f"WITH {_CELLS} SELECT query_id, max(CASE WHEN size = 256 THEN rank END) AS rank_256, max(CASE WHEN size = 512 THEN rank END) AS rank_512, max(CASE WHEN size = 1024 THEN rank END) AS rank_1024 FROM h WHERE method = 'dense' GROUP BY query_id")
def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.rank_changes(cells(spark, sf_dir).filter("method = 'dense'"), [256, 512, 1024])


_PAIRED = "pr AS (SELECT doc_id AS item_id, b.text AS q, d.text AS t FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"
_OVERLAP = f"{_PAIRED}, cw AS (SELECT item_id, {CONTENT_SQL.format(x='q')} AS qw, {CONTENT_SQL.format(x='t')} AS tw FROM pr), ov AS (SELECT item_id, CASE WHEN len(qw) > 0 AND len(tw) > 0 THEN len(list_intersect(qw, tw))::DOUBLE / len(qw) END AS overlap FROM cw)"


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one of the questions in turn."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("asked"), F.col("text").alias("q"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("t"), (F.col("doc_id") % b.count()).alias("asked"))
    pairs = d.join(b, "asked")
    return K.lexical_overlap(pairs, "q", "t").select("item_id", "overlap")


@query("lexical_overlap", f"WITH {_OVERLAP} SELECT item_id, round(overlap, 6) AS overlap FROM ov")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).withColumn("overlap", F.round("overlap", 6))


@query("overlap_bands", f"WITH {_OVERLAP} SELECT CASE WHEN overlap IS NULL THEN 'n/a' WHEN overlap < 1.0::DOUBLE / 3 THEN 'low' WHEN overlap < 2.0::DOUBLE / 3 THEN 'medium' ELSE 'high' END AS band, count(*) AS n FROM ov GROUP BY 1")
def overlap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).groupBy(J.band(F.col("overlap")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("rare_words", f"SELECT word, count(DISTINCT conv_id) AS n FROM (SELECT conv_id, unnest({CONTENT_SQL.format(x='text')}) AS word FROM conversations) GROUP BY word HAVING count(DISTINCT conv_id) <= 3")
def rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rare_words(table(spark, sf_dir, "conversations"), "conv_id", "text")


@query("main_speakers", "SELECT role, count(*) AS n FROM conversations GROUP BY role HAVING count(*) >= 60")
def main_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n")).filter("n >= 60")


@query(
    "nearest_rank_percentile",
    "SELECT lang, x[greatest(1, round_even(0.1 * len(x), 0)::BIGINT)] AS p10, x[greatest(1, round_even(0.5 * len(x), 0)::BIGINT)] AS p50, x[greatest(1, round_even(0.9 * len(x), 0)::BIGINT)] AS p90 FROM (SELECT lang, list(n_chars ORDER BY n_chars) AS x FROM documents GROUP BY lang)",
)
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.nearest_rank(table(spark, sf_dir, "documents"), ["lang"], "n_chars", [0.1, 0.5, 0.9])


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return items, items.filter("id % 4 = 0").withColumn("id", F.col("id") + F.when(F.col("id") % 8 == 0, 100000).otherwise(0)).withColumn("question", F.upper("question"))


_HELD = """it AS (SELECT item_id AS id, text AS question FROM benchmark), pro AS (SELECT CASE WHEN id % 8 = 0 THEN id + 100000 ELSE id END AS id, upper(question) AS question FROM it WHERE id % 4 = 0),
held AS (SELECT * FROM it WHERE id IN (SELECT id FROM pro) OR trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) IN (SELECT trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) FROM pro))"""


@query("heldout_guard", f"WITH {_HELD} SELECT id FROM held")
def heldout_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.held_out(*_items(spark, sf_dir)).select("id")


@query("heldout_clean", f"WITH {_HELD} SELECT id FROM it WHERE id NOT IN (SELECT id FROM held)")
def heldout_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, protected = _items(spark, sf_dir)
    return items.join(K.held_out(items, protected).select("id"), "id", "left_anti").select("id")


_KINDS = "kinds AS (SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang)"
_QUOTAS = _KINDS + f""", ex AS (SELECT kind, n, n * 20.0::DOUBLE / sum(n) OVER () AS e FROM kinds), pl AS (SELECT *, floor(e)::BIGINT AS w, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, md5('7:' || kind)) AS place FROM ex),
quotas AS (SELECT kind, n, w + CASE WHEN place <= 20 - sum(w) OVER () THEN 1 ELSE 0 END AS quota FROM pl)"""


@query("type_quotas", f"WITH {_QUOTAS} SELECT kind, n, quota::BIGINT AS quota FROM quotas")
def type_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.type_quotas(table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("n")), 20, 7)


_STRATA = """av AS (SELECT doc_id AS id, 'lang' AS a, coalesce(lang, '') AS v FROM documents UNION ALL SELECT doc_id, 'source', coalesce(source, '') FROM documents UNION ALL SELECT doc_id, 'sizes', unnest([(n_chars // 1000)::VARCHAR, (n_chars % 3)::VARCHAR]) FROM documents),
wh AS (SELECT a, v, count(*) AS n FROM av GROUP BY ALL)"""


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array(F.expr("n_chars div 1000"), F.col("n_chars") % 3)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", sizes.alias("sizes"))


def _imbalance_sql(drawn: str, share: str) -> str:
    """Of draws (draw, id), all attribute values counted, those that a draw lacks too."""
    return f"""cn AS (SELECT draw, a, v, count(*) AS n FROM {drawn} JOIN av USING (id) GROUP BY ALL), im AS (SELECT draw, round(sum(abs(coalesce(cn.n, 0) - wh.n * {share})), 9) AS imbalance FROM (SELECT DISTINCT draw FROM {drawn}) CROSS JOIN wh LEFT JOIN cn USING (draw, a, v) GROUP BY draw)"""


@query("imbalance", f"WITH {_STRATA}, dr AS (SELECT doc_id % 5 AS draw, doc_id AS id FROM documents), {_imbalance_sql('dr', '0.2::DOUBLE')} SELECT draw, round(imbalance, 6) AS imbalance FROM im")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _strata(spark, sf_dir)
    drawn = items.select((F.col("id") % 5).alias("draw"), "id")
    return K.imbalance(drawn, K.attributes(items, ["lang", "source", "sizes"]), 0.2).withColumn("imbalance", F.round("imbalance", 6))


@query(
    "choose_dev",
    f"""WITH {_QUOTAS}, {_STRATA}, ea AS (SELECT doc_id AS id, lang AS kind, unnest(range(25)) AS draw FROM documents),
od AS (SELECT *, row_number() OVER (PARTITION BY draw, kind ORDER BY md5(concat_ws(':', '7', draw::VARCHAR, id::VARCHAR))) AS place FROM ea), dr AS (SELECT draw, id FROM od JOIN quotas USING (kind) WHERE place <= quota),
{_imbalance_sql('dr', '(20.0::DOUBLE / (SELECT count(*) FROM documents))')}, bs AS (SELECT * FROM im ORDER BY imbalance, draw LIMIT 1) SELECT id, draw::BIGINT AS draw, round(imbalance, 6) AS imbalance FROM dr JOIN bs USING (draw)""",
)
def choose_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = K.choose_dev(_strata(spark, sf_dir), "lang", ["lang", "source", "sizes"], 20, 25, 7)
    return chosen.select("id", F.col("draw").cast("long").alias("draw"), F.round("imbalance", 6).alias("imbalance"))


@query(
    "content_fingerprint",
    """WITH d AS (SELECT sha256(concat_ws(chr(31), item_id::VARCHAR, item_id::VARCHAR, text)) AS d FROM benchmark), b AS (SELECT substr(d, 1, 1) AS b, sha256(string_agg(d, '' ORDER BY d)) AS s FROM d GROUP BY 1)
SELECT sha256(string_agg(b || s, '' ORDER BY b)) AS sha256 FROM b""",
)
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.fingerprint(table(spark, sf_dir, "benchmark"), "item_id", ["item_id", "text"])


@query("vector_checks", "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_size, 0::BIGINT AS not_finite, count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.001) AS not_unit FROM embeddings")
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.vector_checks(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"), 64)


@query("verify_checks", "SELECT * FROM (VALUES ('documents', (SELECT count(*) FROM documents), (SELECT count(*) - count(DISTINCT doc_id) FROM documents)), ('benchmark', (SELECT count(*) FROM benchmark), (SELECT count(*) - count(DISTINCT item_id) FROM benchmark)), ('embeddings', (SELECT count(*) FROM embeddings), (SELECT count(*) - count(DISTINCT vec_id) FROM embeddings))) t(component, n, repeated_ids)")
def verify_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .verify import table_checks

    return table_checks({n: (table(spark, sf_dir, n), k) for n, k in (("documents", "doc_id"), ("benchmark", "item_id"), ("embeddings", "vec_id"))})
