"""Functions that run on executors travel there whole, so the workers need not import the package; their input comes in bounded batches."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship_by_value(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of at most so many bytes: 10,000 rows of long texts or packed vectors would take hundreds of MB."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
