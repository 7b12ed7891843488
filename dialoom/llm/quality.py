"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Signals are shares of a text. The sketch of a signal in a group is a DDSketch (Masson, Rim and Lee):
counts by the logarithm of the value to the base (1 + a) / (1 - a), so any quantile comes within the
share a of the true one. Sketches merge by adding counts, so order and partitions never matter, and
have at most some 1,500 counts, because a share is 0 or at least one over a text's length. Thresholds
are upper fences of each (language, source) group, from sketches that merge upwards (language, then
all) where a group is small.

Native: DataFrame functions only.

Defined cases: a null text counts as empty; null language and source form groups of their own;
repeated rows are judged alike, each on its own; an empty table gives an empty result; columns
of the input are never touched (signals live in one struct column).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, group_key, let, words


@dataclass(frozen=True)
class QualityConfig:
    """Fence = q(high) + spread * max(q(high) - q(low), floor of the signal)."""

    #: Relative accuracy of the sketches.
    accuracy: float = 0.01

    low: float = 0.25
    high: float = 0.75
    spread: float = 3.0
    #: Groups below so many documents use the sketch of their language, then that of all.
    min_docs: int = 50
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Signal: least spread.
    floors: tuple[tuple[str, float], ...] = (("symbols", 0.02), ("dup_lines", 0.2), ("repeats", 0.1), ("capitals", 0.04))

    def base(self) -> float:
        return (1 + self.accuracy) / (1 - self.accuracy)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more, first included."""

    def covered(pos: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(pos) - 1), lambda k: F.least(F.lit(3), F.get(pos, k) - F.get(pos, k - 1)))
        return F.aggregate(steps, F.lit(3), lambda a, x: a + x)

    def by_sort(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)

    def count(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
        near = lambda d: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda k: F.array_contains(d, F.get(h, k)))
        # Few repeated windows: look each word's window up; many: sort windows with their places. Same count.
        return let(twice, lambda d: F.when(F.size(d) == 0, F.lit(0)).otherwise(let(F.when(F.size(d) <= 8, near(d)).otherwise(by_sort(h)), covered)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def features(text: Column) -> Column:
    """The counts of one text, as a struct."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.length(F.regexp_replace(whole, "[^A-Z!]+", "")).cast("long").alias("n_capitals"),
        )

    return let(words(text), of_words)


def signals(q: Column) -> dict[str, Column]:
    share = lambda a, b: F.least(F.lit(1.0), a.cast("double") / F.greatest(b, F.lit(1)).cast("double"))
    return {
        "symbols": share(q["n_symbols"], q["word_chars"]),
        "dup_lines": share(q["lines"]["dup"], q["lines"]["n"]),
        "repeats": share(q["n_repeat_words"], q["n_words"]),
        "capitals": share(q["n_capitals"], q["word_chars"]),
    }


def base_failed(q: Column, config: QualityConfig) -> Column:
    return (q["n_words"] < config.min_words) | (q["n_repeat_words"] * 100 > q["n_words"] * config.max_repeat_percent)


#: The bin of the value 0.
ZERO = -(1 << 30)


def bin_of(value: Column, config: QualityConfig) -> Column:
    """The sketch's bin: base ** (bin - 1) < value <= base ** bin (up to rounding)."""
    return F.when(value <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(value) / F.lit(math.log(config.base())) - F.lit(1e-9)).cast("int"))


def value_of(at: Column, config: QualityConfig) -> Column:
    """What stands for the values of a bin: within the accuracy of each."""
    return F.when(at == ZERO, F.lit(0.0)).otherwise(F.lit(2 / (config.base() + 1)) * F.pow(F.lit(config.base()), at))


def sketches(measured: DataFrame, names: list[str], config: QualityConfig) -> DataFrame:
    """One row per (language, source, signal, bin) with its count: the mergeable sketches."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), bin_of(F.col("_s")[n], config).alias("bin")) for n in names]))
    return measured.select("_lang", "_group", pairs.alias("p")).groupBy("_lang", "_group", "p.signal", "p.bin").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, config: QualityConfig) -> DataFrame:
    """Fences by group: its own where it has min_docs documents, else its language's, else those of all."""

    def fences(at: list[str], tag: str) -> DataFrame:
        merged = sketch.groupBy(*at, "signal", "bin").agg(F.sum("n").alias("n"))
        whole = merged.groupBy(*at, "signal").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("docs"))

        def quantile(p: float) -> Column:
            """The bin where the counts come to the share p."""
            need = F.ceil(F.col("docs") * p)
            step = lambda a, x: F.struct((a["below"] + x["n"]).alias("below"), F.coalesce(a["bin"], F.when(a["below"] + x["n"] >= need, x["bin"])).alias("bin"))
            return F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("int").alias("bin")), step, lambda a: a["bin"])

        made = whole.select(*at, "signal", "docs", value_of(quantile(config.low), config).alias("lo"), value_of(quantile(config.high), config).alias("hi"))
        floor = F.coalesce(*[F.when(F.col("signal") == n, F.lit(v)) for n, v in config.floors])
        fence = F.col("hi") + F.lit(config.spread) * F.greatest(F.col("hi") - F.col("lo"), floor)
        return made.groupBy(*at).agg(*[F.max(F.when(F.col("signal") == n, fence)).alias(n) for n, _ in config.floors], F.max("docs").alias("docs")).select(
            *at, F.struct("docs", *[n for n, _ in config.floors]).alias(tag)
        )

    own, lang = fences(["_lang", "_group"], "own"), fences(["_lang"], "lang")
    every = fences([], "every").select(F.lit(1).alias("_one"), "every")
    joined = own.join(lang, "_lang").withColumn("_one", F.lit(1)).join(every, "_one")
    pick = lambda n: F.when(F.col("own.docs") >= config.min_docs, F.col(f"own.{n}")).when(F.col("lang.docs") >= config.min_docs, F.col(f"lang.{n}")).otherwise(F.col(f"every.{n}"))
    return joined.select("_group", F.struct(*[pick(n).alias(n) for n, _ in config.floors]).alias("_t"))


def judge(docs: DataFrame, config: QualityConfig = QualityConfig(), scratch: Scratch | None = None, carry: list[str] | None = None) -> DataFrame:
    """``_row`` (struct of the carried input columns, all unless named), ``_q`` (counts), ``base_failed`` and ``kept``.

    Counts are computed once and written with what is carried; thresholds are read back as a table of
    known size, which Catalyst broadcasts only under its own threshold and joins by shuffle otherwise.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    names = [n for n, _ in config.floors]
    row = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    measured = docs.select(row.alias("_row"), group_key(F.col("lang")).alias("_lang"), group_key(F.col("lang"), F.col("source")).alias("_group"), features(F.col("text")).alias("_q"))
    measured = measured.withColumn("_s", F.struct(*[c.alias(n) for n, c in signals(F.col("_q")).items()]))
    measured = scratch.keep(measured, "measured")
    fences = scratch.keep(thresholds(sketches(measured, names, config), config).repartition(1), "fences")
    failed = base_failed(F.col("_q"), config)
    over = F.lit(False)
    for n in names:
        over = over | (F.col("_s")[n] > F.col("_t")[n])
    return measured.join(fences, "_group", "left").select("_row", "_q", failed.alias("base_failed"), (~failed & ~F.coalesce(over, F.lit(False))).alias("kept"))


def quality_filter(docs: DataFrame, config: QualityConfig = QualityConfig(), scratch: Scratch | None = None) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return judge(docs, config, scratch).filter("kept").select("_row.*")


def quality_digest(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    return judge(docs, config, carry=["doc_id"]).select(
        F.col("_row.doc_id").alias("doc_id"),
        *[F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols")],
        F.col("_q.lines.dup").alias("n_dup_lines"),
        F.col("_q.n_repeat_words").alias("n_repeat_words"),
        "base_failed",
        "kept",
    )
