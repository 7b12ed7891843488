"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word definitions: space and U+0009 to U+000D.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda's variable is bound to the evaluated value, so no optimizer rule can
    copy a costly expression into every place that uses it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of non-space characters, in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def group_key(*cols: Column) -> Column:
    """A string that tells nulls from every value; for joins on nullable columns."""
    return F.concat_ws("\x01", *[F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string"))) for c in cols])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/checkpoints"


class Scratch:
    """Tables written to the shared checkpoint folder to cut lineage and to be read more than once.

    ``keep`` writes a table and reads it again: the result has known sizes (so that Catalyst
    broadcasts it only below its own threshold) and survives the loss of executors.
    ``drop`` deletes a table that nothing reads any more. The folder goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{scratch_root(spark)}/dialoom-{name}-{uuid.uuid4().hex}"
        self._count = 0
        self._made: list[tuple[DataFrame, str]] = []
        self._path(self.base, lambda fs, path: fs.deleteOnExit(path))

    def _path(self, name: str, act: Callable[[Any, Any], object]) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        act(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        self._count += 1
        path = f"{self.base}/{self._count:03d}-{name}"
        frame.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(frame.schema).parquet(path)
        self._made.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables, of those that ``keep`` made."""
        for kept, path in self._made:
            if any(kept is t for t in tables):
                self._path(path, lambda fs, where: fs.delete(where, True))
        self._made = [x for x in self._made if not any(x[0] is t for t in tables)]

    def drop_but(self, *tables: DataFrame) -> None:
        self.drop(*[t for t, _ in self._made if not any(t is x for x in tables)])

    def feeds(self, frame: DataFrame) -> bool:
        """Whether the frame still reads tables of this folder."""
        leaves = frame._jdf.queryExecution().analyzed().collectLeaves()
        for leaf in map(leaves.apply, range(leaves.size())):
            if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
                if self.base.split(":", 1)[-1] in leaf.relation().location().rootPaths().mkString(","):
                    return True
        return False

    def close(self) -> None:
        """Deletes the folder. What was made of its tables can't be read any more."""
        self._path(self.base, lambda fs, where: fs.delete(where, True))
        self._made = []


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of at most so many bytes: rows with long texts or large sets would fill batches of 10,000 rows with hundreds of MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


class Bitmap:
    """Which 64-bit hashes may be among those of a table: two bits for each, in one array that rows are tested against.

    It only prunes what a join then decides, so its size is bounded whatever the table's: ``per`` bits a
    hash, ``least`` at least and ``most`` at most (powers of two; 8 MB as it stands).
    """

    def __init__(self, hashes: DataFrame, scratch: Scratch, per: int = 64, least: int = 1 << 18, most: int = 1 << 26) -> None:
        """``hashes`` has one column, h."""
        n = hashes.count()
        self.bits = min(most, max(least, 1 << math.ceil(math.log2(max(1, per * n)))))
        low, high = self._places(F.col("h"))
        bit = hashes.select(F.explode(F.array(low, high)).alias("bit"))
        ones = bit.select(F.shiftright("bit", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int")).alias("v"))
        zeros = hashes.sparkSession.range(self.bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
        words = ones.unionByName(zeros).groupBy("w").agg(F.bit_or("v").alias("v"))
        self.table = scratch.keep(words.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words")), "bitmap")

    def _places(self, h: Column) -> tuple[Column, Column]:
        return h.bitwiseAND(F.lit(self.bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(self.bits - 1))

    def has(self, h: Column) -> Column:
        words = self.table.scalar()
        test = lambda bit: F.bit_get(F.get(words, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
        low, high = self._places(h)
        return F.coalesce(test(low) & test(high), F.lit(False))


def without(docs: DataFrame, hashed: Column, same: Callable[[DataFrame], Column], gone: DataFrame, bitmap: Bitmap) -> DataFrame:
    """The rows that match none of ``gone``. Only rows whose hash is in its bitmap are shuffled for the join; the others pass as they stand."""
    maybe = bitmap.has(hashed)
    return docs.filter(~maybe).unionByName(docs.filter(maybe).join(gone, same(gone), "left_anti"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_by_value(module: str) -> None:
    """Functions of this module travel to the workers whole, so these need not import the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
