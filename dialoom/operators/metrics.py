"""Retrieval metrics over ranked chunks, their averages, and comparisons between cells.

``hits``: query_id, rank, target (number of the target that the ranked chunk hits), one row each.
``requirements``: query_id, requirement, target. A requirement is reached by any of its targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Evaluation


def score_rankings(hits: DataFrame, requirements: DataFrame, config: Evaluation = Evaluation()) -> DataFrame:
    """One row for each query: rr, first_relevant_rank (within the largest k), hit@k, recall@k, all@k (null for single requirements)."""
    top = max(config.ks)
    best = requirements.join(hits.select("query_id", "target", "rank"), ["query_id", "target"], "left").groupBy("query_id", "requirement").agg(F.min("rank").alias("r"))
    reached = lambda k: F.when(F.col("r") <= k, 1.0).otherwise(0.0)
    first = F.min(F.when(F.col("r") <= top, F.col("r")))
    aggs = [F.count(F.lit(1)).alias("n_requirements"), first.alias("first_relevant_rank"), F.min("r").alias("first_relevant_rank_in_depth"), F.coalesce(F.lit(1.0) / first, F.lit(0.0)).alias("rr")]
    aggs += [F.max(reached(k)).alias(f"hit_{k}") for k in config.ks] + [F.avg(reached(k)).alias(f"recall_{k}") for k in config.ks]
    aggs += [F.when(F.count(F.lit(1)) > 1, F.min(reached(k))).alias(f"all_{k}") for k in config.all_ks]
    return best.groupBy("query_id").agg(*aggs)


def target_first_ranks(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, ranks): the first rank of every target in target order, null where it has none, over the full depth."""
    best = targets.select("query_id", "target").distinct().join(hits, ["query_id", "target"], "left").groupBy("query_id", "target").agg(F.min("rank").alias("r"))
    return best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("target", F.struct("r").alias("v")))), lambda x: x["v"]["r"]).alias("ranks"))


def averages(rows: DataFrame, names: list[str], places: int = 4, by: str | None = None) -> DataFrame:
    """Means without nulls, overall (``by`` null) and for each non-null value of ``by``."""
    aggs = [F.bround(F.avg(n), places).alias(n) for n in names] + [F.count(F.lit(1)).alias("n")]
    aggs += [F.count(n).alias("n_all_targets") for n in names if n.startswith("all_")][:1]
    overall = rows.agg(*aggs)
    if by is None:
        return overall
    return overall.withColumn(by, F.lit(None).cast(rows.schema[by].dataType)).unionByName(rows.filter(F.col(by).isNotNull()).groupBy(by).agg(*aggs))


def hits_at(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, hit): whether each query reaches any requirement in the top k."""
    return rows.select("query_id", (F.col(f"hit_{k}") == 1.0).alias("hit"))


def outcome_buckets(cells: DataFrame) -> DataFrame:
    """(query_id, bucket) from (query_id, method, hit) of bm25, dense and hybrid; a query may be in several buckets."""
    wide = cells.groupBy("query_id").pivot("method", ["bm25", "dense", "hybrid"]).agg(F.max("hit"))
    b, d, h = (F.col(m) for m in ("bm25", "dense", "hybrid"))
    put = lambda name, when: F.when(when, F.lit(name))
    named = F.array_compact(F.array(put("both_hit", b & d), put("bm25_only", b & ~d), put("dense_only", ~b & d), put("both_missed", ~b & ~d), put("hybrid_recovery", h & ~b & ~d), put("hybrid_regression", ~h & (b | d))))
    return wide.select("query_id", F.explode(named).alias("bucket"))


def size_sensitive(cells: DataFrame) -> DataFrame:
    """(method, query_id) whose hit differs between sizes, from (method, size, query_id, hit)."""
    return cells.groupBy("method", "query_id").agg(F.count_distinct("hit").alias("n")).filter("n > 1").select("method", "query_id")


def rank_changes(cells: DataFrame, sizes: list[int]) -> DataFrame:
    """First rank of each query by size, one column a size."""
    wide = cells.groupBy("query_id").pivot("size", sizes).agg(F.min("rank"))
    return wide.select("query_id", *[F.col(str(s)).alias(f"rank_{s}") for s in sizes])


def partial_hits(rows: DataFrame, k: int) -> DataFrame:
    """Queries that reach some but not all of their requirements."""
    return rows.filter((F.col(f"hit_{k}") == 1.0) & (F.col(f"recall_{k}") < 1.0)).select("query_id")


def nearest_rank(frame: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Nearest-rank percentiles p<q>: the element at max(1, half-even round of q * n). Ordered are the distinct values of a key, with their counts."""
    by = Window.partitionBy(*keys)
    counts = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = counts.withColumn("_upto", F.sum("_c").over(by.orderBy(value))).withColumn("_n", F.sum("_c").over(by))
    at = lambda q: F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.bround(F.col("_n") * q, 0).cast("long")), F.col(value)))
    return ranked.groupBy(*keys).agg(*[at(q).alias(f"p{round(q * 100)}") for q in qs])


def band(overlap: Column) -> Column:
    return F.when(overlap.isNull(), "n/a").when(overlap < 1 / 3, "low").when(overlap < 2 / 3, "medium").otherwise("high")
