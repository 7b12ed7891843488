"""BM25, dense, hybrid: questions are the benchmark's items, chunks the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from .registry import query, table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", F.array("lang", "source").alias("speakers"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.array(F.col("label").cast("string")).alias("speakers"), "label")


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: the vectors of every 50th id."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


TIE = "('0x' || substr(sha1(chunk_id::VARCHAR), 1, 15))::BIGINT"
BM25 = """d AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
post AS (SELECT chunk_id, dl, term, count(*) AS f FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats),
bm25 AS (SELECT query_id, chunk_id, sum((idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl)) * times)::DECIMAL(38, 15))::DOUBLE AS score
  FROM post JOIN idf USING (term) JOIN q USING (term), stats WHERE idf > 0 GROUP BY ALL)"""
DENSE = """v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vector, label FROM embeddings),
dense AS (SELECT a.chunk_id AS query_id, b.chunk_id, list_dot_product(b.vector, a.vector) AS score, b.label FROM v a, v b WHERE a.chunk_id % 50 = 0)"""


def ranked_sql(source: str, k: int, where: str = "true") -> str:
    return f"SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round_even(score, 12) DESC, {TIE}) AS rank FROM {source} WHERE {where} QUALIFY rank <= {k}"


OUT = "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM"


@query("bm25_topk", f"WITH {BM25} {OUT} ({ranked_sql('bm25', 8)})")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.Bm25(chunks(spark, sf_dir)).search(questions(spark, sf_dir), 8))


@query("bm25_filtered", f"WITH {BM25}, b AS (SELECT bm25.* FROM bm25 JOIN documents ON doc_id = chunk_id WHERE lang = 'en' AND source = 'src1') {OUT} ({ranked_sql('b', 8)})")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters act on scores; statistics cover all chunks."""
    return shown(R.Bm25(chunks(spark, sf_dir)).search(questions(spark, sf_dir), 8, R.Filters(speakers=("en", "src1"))))


@query(
    "bm25_idf",
    """WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(greatest(ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5), 0.0), 6) AS idf FROM p, n GROUP BY term""",
)
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chunks(spark, sf_dir)
    return R.bm25_idf(R.postings(docs), docs.agg(F.count(F.lit(1)).alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query("tiebreak_order", "SELECT doc_id AS chunk_id, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 15))::BIGINT AS tiebreak FROM documents")
def tiebreak_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", R.tiebreak(F.col("chunk_id")).alias("tiebreak"))


@query("duplicate_chunk_ids", "SELECT doc_id % 997 AS chunk_id, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unique_ids(chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id") % 997))


@query("dense_topk", f"WITH {DENSE} {OUT} ({ranked_sql('dense', 8)})")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.Dense(vectors(spark, sf_dir)).search(asked_vectors(spark, sf_dir), 8))


@query("dense_filtered", f"WITH {DENSE} {OUT} ({ranked_sql('dense', 8, 'label = 3')})")
def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.Dense(vectors(spark, sf_dir)).search(asked_vectors(spark, sf_dir), 8, R.Filters(speakers=("3",))))


def _bow_sql(source: str, key: str, name: str) -> str:
    return f"""{name}_t AS (SELECT {key} AS id, ('0x' || right(md5(w), 2))::INT % 64 AS bucket, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {source}) GROUP BY ALL),
{name}_r AS (SELECT g.id, list(coalesce(n, 0)::DOUBLE + CASE WHEN i = 0 THEN 0.001 ELSE 0 END ORDER BY i) AS raw FROM (SELECT {key} AS id, unnest(range(64)) AS i FROM {source}) g LEFT JOIN {name}_t t ON t.id = g.id AND t.bucket = g.i GROUP BY g.id),
{name} AS (SELECT id, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS vector FROM {name}_r)"""


BOW = f"{_bow_sql('documents', 'doc_id', 'bd')}, {_bow_sql('benchmark', 'item_id', 'bq')}, bow AS (SELECT bq.id AS query_id, bd.id AS chunk_id, list_dot_product(bd.vector, bq.vector) AS score FROM bd, bq)"


def bow_scores(spark: SparkSession, sf_dir: str, k: int | None = None, filters: R.Filters = R.Filters()) -> DataFrame:
    docs = R.embed_words(chunks(spark, sf_dir).filter(filters.column()), "chunk_id")
    return R.dense_scores(docs, R.embed_words(questions(spark, sf_dir), "query_id"), k)


@query("bow_embed_dense_topk", f"WITH {BOW} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({ranked_sql('bow', 8)})")
def bow_embed_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.top_k(bow_scores(spark, sf_dir, 8), 8))


FUSED = f"""ra AS ({ranked_sql('{a}', 30)}), rb AS ({ranked_sql('{b}', 30)}),
fused AS (SELECT query_id, chunk_id, sum((1.0::DOUBLE / (60 + rank))::DECIMAL(38, 15))::DOUBLE AS score, max(CASE WHEN m = 'bm25' THEN rank END) AS bm25_rank, max(CASE WHEN m = 'dense' THEN rank END) AS dense_rank
  FROM (SELECT *, 'bm25' AS m FROM ra UNION ALL SELECT *, 'dense' AS m FROM rb) GROUP BY ALL)"""


def _with_ranks(frame: DataFrame) -> list:
    return [F.try_element_at("components", F.lit(m)).cast("long").alias(f"{m}_rank") for m in ("bm25", "dense")]


@query("rrf_fusion", f"WITH {BM25}, {BOW}, {FUSED.format(a='bm25', b='bow')} SELECT query_id, chunk_id, round(score, 6) AS score, bm25_rank, dense_rank FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = R.Bm25(chunks(spark, sf_dir)).search(questions(spark, sf_dir), 30).withColumn("method", F.lit("bm25"))
    b = R.top_k(bow_scores(spark, sf_dir, 30), 30).withColumn("method", F.lit("dense"))
    fused = R.fuse(a.unionByName(b))
    return fused.select("query_id", "chunk_id", F.round("score", 6).alias("score"), *_with_ranks(fused))


def _hybrid(spark: SparkSession, sf_dir: str, filters: R.Filters = R.Filters()) -> DataFrame:
    docs = chunks(spark, sf_dir)
    scored = {"bm25": R.bm25_best(docs, questions(spark, sf_dir), 30, among=docs.filter(filters.column())), "dense": bow_scores(spark, sf_dir, 30, filters)}
    out = R.hybrid(scored, 8)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), *_with_ranks(out))


_HYBRID_OUT = "SELECT query_id, chunk_id, rank, round(score, 6) AS score, bm25_rank, dense_rank FROM (" + ranked_sql("fused", 8).replace("SELECT query_id, chunk_id, score,", "SELECT query_id, chunk_id, score, bm25_rank, dense_rank,") + ")"


@query("hybrid_topk", f"WITH {BM25}, {BOW}, {FUSED.format(a='bm25', b='bow')} {_HYBRID_OUT}")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir)


@query(
    "hybrid_filtered",
    f"WITH {BM25}, {BOW}, fa AS (SELECT bm25.* FROM bm25 JOIN documents ON doc_id = chunk_id WHERE lang = 'en'), fb AS (SELECT bow.* FROM bow JOIN documents ON doc_id = chunk_id WHERE lang = 'en'), {FUSED.format(a='fa', b='fb')} {_HYBRID_OUT}",
)
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters act before the fusion depth is cut."""
    return _hybrid(spark, sf_dir, R.Filters(speakers=("en",)))
