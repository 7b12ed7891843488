"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / quality, u a hash of its id. A source's budget is spent on
complete epochs first; what is left goes to its documents by ascending key until the budget is
reached, and the last one is cut to what remains. No source is ever sorted whole: sizes are summed
by (source, key bucket), buckets below the budget's edge are taken, and only the bucket on the edge
is ordered.

The table of sources (one row each) is ordered in one task; documents never are.

Defined cases: a null text has size 0; null sources form one source, the last in order; null ids
share one random number; repeated rows are separate documents; an empty table gives an empty result;
a corpus without words has targets of 0. Input columns live in one struct, so none can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, group_key, let, words


@dataclass(frozen=True)
class MixConfig:
    #: Weights of the sources in code point order, repeating.
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: Times its own size that a source may give.
    most: int = 3
    seed: str = "mix-1"
    buckets: int = 4096


def quality_weight(text: Column, word_chars: Column) -> Column:
    """1 for a text without markup symbols, less with their share, 0.1 at least."""
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>]+", ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * symbols / F.greatest(word_chars, F.lit(1)))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a hash: the same on every run."""
    hexa = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(hexa, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, config: MixConfig) -> DataFrame:
    """``sizes`` (_src, source, source_size) with weight and target: min(most * size, level * weight)."""
    w = F.element_at(F.array(*[F.lit(x) for x in config.weights]), ((F.col("rank") - 1) % len(config.weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    ranked = ranked.withColumn("cap", F.col("source_size") * config.most)
    every = Window.partitionBy(F.lit(1))
    before = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - spent("cap")) / (F.sum("weight").over(every) - spent("weight"))
    leveled = ranked.withColumn("level", level)
    # The lowest-capped source whose cap the level doesn't pass: from there on nothing is capped.
    found = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", "level"))).over(every)["level"]
    return leveled.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(found, F.lit(0.0)) * F.col("weight"))).select("_src", "source", "source_size", "weight", "target")


def mix(docs: DataFrame, config: MixConfig = MixConfig(), scratch: Scratch | None = None, carry: list[str] | None = None) -> DataFrame:
    """``_row`` (the carried columns), size, source_size, target and taken of every document."""
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    row = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    counted = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).alias("chars")))
    sized = docs.select(row.alias("_row"), F.col("doc_id").alias("_id"), "source", "text", counted.alias("_n"))
    key = -F.log(uniform(F.col("_id"), config.seed)) / quality_weight(F.col("text"), F.col("_n.chars"))
    sized = sized.select("_row", "_id", group_key(F.col("source")).alias("_src"), "source", F.col("_n.n").alias("size"), key.alias("_key"))
    sized = sized.withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key"))) * config.buckets))
    if carry:  # few columns are kept; whole rows are sized again rather than copied
        sized = scratch.keep(sized, "sized")

    sums = scratch.keep(sized.groupBy("_src", "source", "_bucket").agg(F.sum("size").alias("size")), "sums")
    targets = source_targets(sums.groupBy("_src", "source").agg(F.sum("size").alias("source_size")), config)
    quota = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(quota / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    planned = targets.withColumn("_epochs", epochs.cast("long")).withColumn("_rest", quota - F.col("_epochs") * F.col("source_size"))
    by = Window.partitionBy("_src").orderBy("_bucket")
    filled = sums.withColumn("_upto", F.sum("size").over(by)).select("_src", "_bucket", "size", "_upto").join(planned, "_src")
    on_edge = (F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("size") < F.col("_rest"))
    plan = filled.groupBy("_src", "source_size", "target", "_epochs").agg(
        F.coalesce(F.min(F.when(on_edge, F.col("_bucket"))), F.lit(-1)).alias("_edge"), F.coalesce(F.min(F.when(on_edge, F.col("_rest") - F.col("_upto") + F.col("size"))), F.lit(0)).alias("_left")
    )
    placed = sized.drop("source").join(scratch.keep(plan.repartition(1), "plan"), "_src")
    out = ["_row", "size", "source_size", "target"]
    whole = placed.filter("_bucket <> _edge").select(*out, ((F.col("_epochs") + F.when(F.col("_bucket") < F.col("_edge"), 1).otherwise(0)) * F.col("size")).alias("taken"))
    before = F.sum("size").over(Window.partitionBy("_src").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.coalesce(before, F.lit(0))))
    edge = placed.filter("_bucket = _edge").select(*out, (F.col("_epochs") * F.col("size") + more).alias("taken"))
    return whole.unionByName(edge)


def mix_digest(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    return mix(docs, config, carry=["doc_id"]).select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def mix_select(docs: DataFrame, config: MixConfig = MixConfig(), scratch: Scratch | None = None) -> DataFrame:
    """The documents that the mix takes, with mix_size, mix_target and mix_taken; input columns of these names are replaced."""
    mixed = mix(docs, config, scratch).filter("taken > 0")
    made = {"mix_size": "size", "mix_target": "target", "mix_taken": "taken"}
    return mixed.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in made], *[F.col(c).alias(n) for n, c in made.items()])
