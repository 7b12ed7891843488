"""URL verdicts by Bloom filter cascades: exact membership over the corpus's keys, without joins.

A key is a host suffix with a path prefix. The universe is every key that a url of the corpus can
have at the label counts and prefix lengths that occur in the lists. Level 1 of a cascade encodes
the listed keys of the universe, level 2 the other keys that level 1 takes in, level 3 the listed
keys that level 2 takes in, and so on until nothing is taken in wrongly. A key of the universe is
listed exactly if the first level that lacks it is an even one (or the levels end after an odd one).

Native: DataFrame functions only. Filters reach the urls as scalar subqueries. Their size is bounded:
``max_keys`` keys at 13 bits, about 16 MB; a longer list is refused, to be split by the caller.

Defined cases: null urls and urls without ``://`` have an empty host and path, fit no rule and are
allowed; repeated rows are judged alike; an empty table gives an empty result; only page_id and url
are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch

#: Bits of one shard, keys meant for it, probes for a key.
_BITS, _KEYS, _PROBES = 32768, 2500, 7


@dataclass(frozen=True)
class UrlConfig:
    #: (host, path, verdict): the longest rule that fits a url decides.
    rules: tuple[tuple[str, str, str], ...] = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
    #: Hosts that are blocked, with their subdomains, where no rule fits.
    hosts: tuple[str, ...] = tuple(f"{name}.example.{end}" for name in ("casino-win", "cheap-pills", "free-bets", "ads-track", "spam-farm", "adult-x") for end in ("com", "net", "org"))
    max_keys: int = 10_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """The key of a url for each (labels, path length); null where the url is shorter."""
    labels = F.size(F.split(host, "\\."))
    fits = lambda n, length: (labels >= n) & (F.length(path) >= length) & (host != "")
    return [F.when(fits(n, length), F.concat(F.substring_index(host, ".", -n), F.substr(path, F.lit(1), F.lit(length)))) for n, length in shapes]


def _hash(key: Column, level: int, shards: int) -> tuple[Column, Column, Column]:
    a, b = F.xxhash64(F.lit(level), key), F.xxhash64(key, F.lit(level))
    return F.pmod(a, F.lit(shards)), F.shiftrightunsigned(b, 33), F.shiftrightunsigned(F.shiftleft(b, 32), 33).bitwiseOR(F.lit(1))


class Cascade:
    """Levels of filters, each an array of shards, each shard an array of 64-bit words."""

    def __init__(self) -> None:
        self.levels: list[tuple[DataFrame, int]] = []

    def _in_level(self, key: Column, level: int) -> Column:
        table, shards = self.levels[level]
        s, a, b = _hash(key, level, shards)
        words, hit = F.get(table.scalar(), s.cast("int")), F.lit(True)
        for i in range(_PROBES):
            bit = F.pmod(a + b * i, F.lit(_BITS)).cast("int")
            hit = hit & (F.bit_get(F.get(words, F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1)
        return hit

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._in_level(key, level), out).otherwise(F.lit(level % 2 == 1))
        return key.isNotNull() & out

    def add(self, keys: DataFrame, n: int, scratch: Scratch) -> None:
        """A level that encodes these keys. Words that no key sets are there as zeros."""
        level, shards = len(self.levels), max(1, -(-n // _KEYS))
        s, a, b = _hash(F.col("key"), level, shards)
        probes = F.explode(F.array(*[F.pmod(F.col("a") + F.col("b") * i, F.lit(_BITS)) for i in range(_PROBES)]))
        bits = keys.select(s.alias("s"), a.alias("a"), b.alias("b")).select("s", probes.alias("bit"))
        ones = bits.select("s", F.shiftright("bit", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int")).alias("v"))
        spark = keys.sparkSession
        zeros = spark.range(shards).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_BITS // 64 - 1).cast("long"))).alias("w"), F.lit(0).cast("long").alias("v"))
        words = ones.unionByName(zeros).groupBy("s", "w").agg(F.bit_or("v").alias("v"))
        by_shard = words.groupBy("s").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("ws"))
        whole = by_shard.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "ws"))), lambda x: x["ws"]).alias("filter"))
        self.levels.append((scratch.keep(whole, f"level{level}"), shards))


def build_cascade(universe: DataFrame, listed: DataFrame, scratch: Scratch, max_keys: int) -> Cascade:
    """``universe`` and ``listed`` have one column, key; the universe's keys are distinct."""
    tagged = universe.join(listed.select("key", F.lit(True).alias("yes")).distinct(), "key", "left")
    tagged = scratch.keep(tagged.select("key", F.coalesce("yes", F.lit(False)).alias("yes")), "tagged")
    inside, outside, cascade = tagged.filter("yes").select("key"), tagged.filter("not yes").select("key"), Cascade()
    n = inside.count()
    while n:
        if n > max_keys:
            raise ValueError(f"{n} keys; one cascade takes {max_keys}: split the list")
        cascade.add(inside, n, scratch)
        wrong = scratch.keep(outside.filter(cascade._in_level(F.col("key"), len(cascade.levels) - 1)), "wrong")
        inside, outside = wrong, inside
        n = inside.count()
    return cascade


def url_verdicts(pages: DataFrame, config: UrlConfig = UrlConfig(), scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and listed_key (the method's hit, where no rule fits)."""
    spark: SparkSession = pages.sparkSession
    scratch = scratch or Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    lists = [(h + p, v) for h, p, v in config.rules] + [(h, "block") for h in config.hosts]
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in config.rules} | {(h.count(".") + 1, 0) for h in config.hosts})
    names = [f"_k{i}" for i in range(len(shapes))]
    keyed = scratch.keep(parts.select("*", *[k.alias(n) for n, k in zip(names, candidate_keys(F.col("host"), F.col("path"), shapes), strict=True)]), "keyed")
    universe = scratch.keep(keyed.select(F.explode(F.array_compact(F.array(*names))).alias("key")).distinct(), "universe")
    listed = spark.createDataFrame(lists, "key string, verdict string")
    block, allow = (build_cascade(universe, listed.filter(F.col("verdict") == v).select("key"), scratch, config.max_keys) for v in ("block", "allow"))

    def hit(i: int) -> Column:
        """Size, then labels, so that the greatest of the hits is the longest rule."""
        k, n = F.col(names[i]), shapes[i][0]
        verdict = F.when(allow.contains(k), F.lit("allow")).when(block.contains(k), F.lit("block"))
        return F.struct(F.length(k).alias("size"), F.lit(n).alias("labels"), k.alias("key"), verdict.alias("verdict"))

    def best(chosen: list[int]) -> Column:
        found = F.filter(F.array(*[F.col(f"_h{i}") for i in chosen]), lambda x: x["verdict"].isNotNull())
        return F.array_max(found)

    hits = keyed.select("page_id", "host", "path", *[hit(i).alias(f"_h{i}") for i in range(len(shapes))])
    ruled = hits.select("page_id", "host", "path", best([i for i, x in enumerate(shapes) if x[1]]).alias("_rule"), best([i for i, x in enumerate(shapes) if not x[1]]).alias("_own"))
    rule, own = F.col("_rule"), F.col("_own")
    return ruled.select("page_id", "host", "path", rule["key"].alias("rule"), F.coalesce(rule["verdict"], own["verdict"], F.lit("allow")).alias("verdict"), F.when(rule.isNull(), own["key"]).alias("listed_key"))
