"""Benchmark decontamination by spaced seeds.

Fixed masks ignore some token positions. Seeds of the benchmark are hashed at every position, seeds
of the documents likewise; a filter of the benchmark's seeds (a bitmap of bounded size) leaves few
of the latter, which are joined on the hash with the former. Around each hit the aligned tokens are
compared: a window of ``window`` tokens (or the whole item, if shorter) with at least ``share`` of
them equal is an overlap, so substituted words are tolerated. Tokens are runs of letters and digits
(and of any non-ASCII character) in lower case.

Native: DataFrame functions only. The bitmap only prunes: the join is exact at any benchmark size.

Items shorter than a window are matched whole. They get masks of their own, which ignore all but one
of as many pieces as leave one without a substitution, so none that ``share`` tolerates is missed;
items of fewer than ``exact`` tokens tolerate none. These masks are only made for the lengths that the
benchmark has.

Defined cases: null and empty texts have no tokens, no overlaps and, as items, match nothing; repeated rows are found each on its own
but reported once per id; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, let, without


@dataclass(frozen=True)
class SeedConfig:
    #: 1: the token counts, 0: it is ignored.
    masks: tuple[str, ...] = ("1101011", "11100101")
    window: int = 14
    share: float = 0.8
    exact: int = 7
    #: Bits of the bitmap: 64 for each seed, within these bounds (powers of two).
    least_bits: int = 1 << 18
    most_bits: int = 1 << 26

    def need(self, length: int) -> int:
        """Equal tokens of a match with an item of this length."""
        return length if length < self.exact else math.ceil(round(self.share * min(self.window, length), 9))

    def pieces(self, length: int) -> list[tuple[int, int]]:
        """(start, tokens) of the pieces of an item shorter than a window, one more than it tolerates substitutions."""
        parts = length - self.need(length) + 1
        edges = [length * k // parts for k in range(parts + 1)]
        return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _seed(t: Column, i: Column, mask: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(t, i + k) for k, c in enumerate(mask) if c == "1"])


def _around(t: Column, i: Column, config: SeedConfig) -> Column:
    """The tokens from one window before the seed to one window after it; null beyond the ends."""
    reach, span = config.window, max(map(len, config.masks))
    return F.transform(F.sequence(i - reach, i + span - 1 + reach), lambda j: F.get(t, j))


def _hashes(t: Column, masks: list[str]) -> Column:
    """The seeds of all positions under the first mask, then those under the next, and so on."""
    none = F.array().cast("array<bigint>")
    of = lambda number, mask: F.transform(F.sequence(F.lit(0), F.size(t) - len(mask)), lambda i: _seed(t, i, mask, number))
    return F.concat(*[F.when(F.size(t) >= len(m), of(k, m)).otherwise(none) for k, m in enumerate(masks)])


def _place(at: Column, size: Column, masks: list[str]) -> tuple[Column, Column]:
    """The mask's number and the token position of the seed at index ``at`` of _hashes."""
    number, out, before = F.lit(0), at, F.lit(0)
    for k, mask in enumerate(masks[:-1]):
        before = before + F.greatest(size - len(mask) + 1, F.lit(0))
        number, out = F.when(at >= before, k + 1).otherwise(number), F.when(at >= before, at - before).otherwise(out)
    return number, out


def seeds(frame: DataFrame, config: SeedConfig, masks: list[str], bitmap: Bitmap | None = None) -> DataFrame:
    """``frame`` (_key, _text) to one row (_key, _len, mask, position, seed, around) for each seed, of those in the bitmap if there is one.

    The bitmap is tested between the generator and the projection that copies tokens, so only hits are ever built.
    """
    both = let(tokens(F.col("_text")), lambda t: F.struct(t.alias("t"), _hashes(t, masks).alias("h")))
    each = frame.select("_key", both.alias("_b")).select("_key", F.col("_b.t").alias("_t"), F.posexplode("_b.h").alias("_at", "seed"))
    if bitmap is not None:
        each = each.filter(bitmap.has(F.col("seed")))
    number, position = _place(F.col("_at"), F.size("_t"), masks)
    return each.select("_key", F.size("_t").alias("_len"), number.alias("mask"), position.alias("position"), "seed", _around(F.col("_t"), position, config).alias("around"))


def item_seeds(benchmark: DataFrame, config: SeedConfig, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """(item_id, need, seed, _of_item) of the items, and the masks: the fixed ones, and those that the lengths of short items need."""
    lengths = benchmark.select(F.size(tokens(F.col("text"))).alias("n")).filter(F.col("n").between(1, config.window - 1)).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # fewer than config.window rows
    runs = sorted({size for n in short for _, size in config.pieces(n)})
    masks = [*config.masks, *("1" * k for k in runs)]
    made = seeds(benchmark.select(F.col("item_id").alias("_key"), F.col("text").alias("_text")), config, masks)
    wanted = F.col("mask") < len(config.masks)
    for n in short:
        here = F.lit(False)
        for start, size in config.pieces(n):
            here = here | ((F.col("mask") == len(config.masks) + runs.index(size)) & (F.col("position") == start))
        wanted = wanted | ((F.col("_len") == n) & here)
    need = F.lit(config.need(config.window))
    for n in short:
        need = F.when(F.col("_len") == n, F.lit(config.need(n))).otherwise(need)
    return scratch.keep(made.filter(wanted).select(F.col("_key").alias("item_id"), need.alias("need"), "seed", F.col("around").alias("_of_item")), "known"), masks


def overlaps(docs: DataFrame, benchmark: DataFrame, config: SeedConfig = SeedConfig(), scratch: Scratch | None = None, key: Column | None = None) -> DataFrame:
    """(key, item_id, n_equal, n_hits): for each document (``key``, doc_id unless given) and item that overlap."""
    scratch = scratch or Scratch(docs.sparkSession, "seeds")
    key = F.col("doc_id") if key is None else key
    known, masks = item_seeds(benchmark, config, scratch)
    bitmap = Bitmap(known.select(F.col("seed").alias("h")), scratch, 64, config.least_bits, config.most_bits)

    hits = seeds(docs.select(key.alias("_key"), F.col("text").alias("_text")), config, masks, bitmap).select("_key", "seed", F.col("around").alias("_of_doc"))
    equal = F.zip_with("_of_doc", "_of_item", lambda a, b: F.when(a == b, 1).otherwise(0))
    best = let(equal, lambda e: F.array_max(F.transform(F.sequence(F.lit(0), F.size(e) - config.window), lambda i: F.aggregate(F.slice(e, i + 1, config.window), F.lit(0), lambda a, x: a + x))))
    joined = hits.join(known, "seed").select("_key", "item_id", "need", best.alias("n_equal")).filter("n_equal >= need")
    return joined.groupBy(F.col("_key").alias("key"), "item_id").agg(F.max("n_equal").cast("long").alias("n_equal"), F.count(F.lit(1)).alias("n_hits"))


def overlap_digest(docs: DataFrame, benchmark: DataFrame, config: SeedConfig = SeedConfig()) -> DataFrame:
    return overlaps(docs, benchmark, config).select(F.col("key").alias("doc_id"), "item_id", "n_equal", "n_hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, config: SeedConfig = SeedConfig(), scratch: Scratch | None = None) -> DataFrame:
    """The documents that overlap with no item. Overlap is a matter of the text, so texts are matched by digest."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    found = overlaps(docs, benchmark, config, scratch, F.sha2(F.col("text"), 256)).select(F.col("key").alias("_digest")).distinct()
    found = scratch.keep(found, "found")
    hashed = lambda digest: F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    bitmap = Bitmap(found.select(hashed(F.col("_digest")).alias("h")), scratch)
    scratch.drop_but(found, bitmap.table)
    rows, digest = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), F.sha2(F.col("_row.text"), 256)
    return without(rows, hashed(digest), lambda gone: digest == gone["_digest"], found, bitmap).select("_row.*")
