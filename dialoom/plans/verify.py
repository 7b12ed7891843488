"""Checks of stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_checks(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(component, n, repeated_ids) of each table with its key."""
    parts = [frame.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated_ids")).select(F.lit(name).alias("component"), "n", "repeated_ids") for name, (frame, key) in tables.items()]
    return reduce(DataFrame.unionByName, parts)
