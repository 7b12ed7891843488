"""Row repair: casts, gap fill from neighbours, source rows, order anomalies, ranges.

Rows carry the ordinal ``csv_record``. ``block`` partitions the look-around windows (a file, say);
without one a window spans the table, which is meant for single files.
"""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def number(c: Column) -> Column:
    """'2.0' to 2, '1.7' to 1, blank to null; null where there is no finite number."""
    d = F.trim(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < 2.0**31), d.cast("int"))


def bad_number(c: Column) -> Column:
    return (F.trim(c) != "") & number(c).isNull()


def _unpack(field: pd.Series) -> pd.DataFrame:
    def one(value: str) -> tuple[str | None, str | None, bool]:
        try:
            got = ast.literal_eval(value.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None, None, False
        good = isinstance(got, tuple) and len(got) == 2 and all(isinstance(x, str) for x in got)
        return (*got, True) if good else (None, None, False)

    return pd.DataFrame([one(v) for v in field], columns=["speaker", "text", "ok"])


def build_rows(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(csv_record, index_field, season, episode, speaker, text), all strings, to rows and dead letters.

    A value in the index field that starts with a bracket must be a pair of strings; it stands in for a
    row whose speaker and text are both blank. Only such rows reach Python.
    """
    names = ("index_field", "season", "episode", "speaker", "text")
    r = records.select("csv_record", *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names])
    unpacked = F.pandas_udf(_unpack, "struct<speaker:string,text:string,ok:boolean>")
    packed = F.col("index_field").rlike(r"^\s*\(")
    plain = r.filter(~packed).withColumn("pair", F.lit(None).cast("struct<speaker:string,text:string,ok:boolean>"))
    both = plain.unionByName(r.filter(packed).withColumn("pair", unpacked("index_field")))
    broken = F.coalesce(~F.col("pair.ok"), F.lit(False))
    error = F.when(broken, F.lit("malformed pair")).when(bad_number(F.col("season")) | bad_number(F.col("episode")), F.lit("not a number"))
    blank = (F.trim("speaker") == "") & (F.trim("text") == "") & F.col("pair").isNotNull()
    rows = both.withColumn("error", error)
    good = rows.filter("error is null").select(
        "csv_record", "index_field", number(F.col("season")).alias("season"), number(F.col("episode")).alias("episode"),
        F.when(blank, F.col("pair.speaker")).otherwise(F.col("speaker")).alias("speaker"), F.when(blank, F.col("pair.text")).otherwise(F.col("text")).alias("text"),
        F.when(blank, F.array(F.lit("unpacked_tuple_row"))).otherwise(F.array().cast("array<string>")).alias("fixes"),
    )
    return good, rows.filter("error is not null").select("csv_record", "error", F.array(*names).alias("fields"))


def not_empty(rows: DataFrame) -> DataFrame:
    return rows.filter((F.trim("speaker") != "") | (F.trim("text") != ""))


def _ordered(order: str, block: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*block).orderBy(order) if block else Window.partitionBy(F.lit(0)).orderBy(order)


def fill_ids(rows: DataFrame, order: str = "csv_record", block: Sequence[str] = ()) -> DataFrame:
    """Rows with ``season`` and ``episode`` filled where both neighbours agree and no half that is there contradicts.

    ``filled`` tells what was done: kept, filled, or unresolved (still without ids).
    """
    w = _ordered(order, block)
    whole = F.when(F.col("season").isNotNull() & F.col("episode").isNotNull(), F.struct("season", "episode"))
    before = F.last(whole, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(whole, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    seen = rows.withColumn("_b", before).withColumn("_a", after)
    half = lambda c: F.col(c).isNull() | (F.col(c) == F.col(f"_b.{c}"))
    has = F.col("season").isNotNull() & F.col("episode").isNotNull()
    can = ~has & (F.col("_b") == F.col("_a")) & half("season") & half("episode")
    state = F.when(has, "kept").when(F.coalesce(can, F.lit(False)), "filled").otherwise("unresolved")
    marked = seen.withColumn("filled", state)
    put = lambda c: F.when(F.col("filled") == "filled", F.col(f"_b.{c}")).otherwise(F.col(c)).alias(c)
    rest = [c for c in rows.columns if c not in ("season", "episode")]
    return marked.select(*rest, put("season"), put("episode"), "filled")


def source_rows(rows: DataFrame) -> DataFrame:
    """``source_row``: the numeric index field, else the distance from the episode's first surviving record."""
    numeric = F.trim("index_field").rlike("^[0-9]+$")
    first = F.min("csv_record").over(Window.partitionBy("season", "episode"))
    return rows.withColumn("source_row", F.when(numeric, F.trim("index_field").try_cast("int")).otherwise((F.col("csv_record") - first).cast("int"))).withColumn("reconstructed", ~numeric)


def order_anomalies(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value doesn't rise within their key."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("previous", before).filter(F.col(value) <= F.col("previous"))


def reopened(rows: DataFrame, keys: Sequence[str], order: str, block: Sequence[str] = ()) -> DataFrame:
    """Rows that begin a further block of a key that was left before."""
    key = F.struct(*keys)
    before = F.lag(key).over(_ordered(order, block))
    first = rows.groupBy(*keys).agg(F.min(order).alias("_first"))
    began = rows.withColumn("_before", before).filter(F.col("_before") != key).drop("_before")
    return began.alias("r").join(first.alias("f"), [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]).filter(F.col(f"r.{order}") > F.col("f._first")).select("r.*")


def describe(rows: DataFrame) -> DataFrame:
    """What a report shows of a row."""
    return rows.select("csv_record", "season", "episode", "speaker", "text")


def load_report(rows: DataFrame, dead: DataFrame, dropped: DataFrame) -> DataFrame:
    """(fact, n): rows loaded, records that failed, rows dropped as unresolved, and how often each fix was made (gaps and rebuilt rows included)."""
    made = rows.select(F.array_compact(F.concat("fixes", F.array(F.when(F.col("filled") == "filled", F.lit("filled_episode_ids")), F.when(F.col("reconstructed"), F.lit("reconstructed_source_row"))))).alias("fixes"))
    count = lambda frame, name: frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fact"), "n")
    return count(rows, "rows").unionByName(count(dead, "failed")).unionByName(count(dropped, "unresolved")).unionByName(fix_counts(made).select(F.col("fix").alias("fact"), "n"))


def ranges(frame: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Runs of consecutive distinct integers: keys, first, last, label ('1-3' or '7')."""
    distinct = frame.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    runs = distinct.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_i")
    text = lambda c: F.col(c).cast("string")
    return runs.withColumn("label", F.when(F.col("first") == F.col("last"), text("first")).otherwise(F.concat(text("first"), F.lit("-"), text("last"))))


def fix_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("fixes").alias("fix")).groupBy("fix").agg(F.count(F.lit(1)).alias("n"))
