"""Line cleaning on a stream. The rules look at one row at a time, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ROW_RULES, TURN_RULES, has_content, split_turns, with_rules


def clean_stream(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` exploded into turns with content: all columns, part, clean_text, text_rules."""
    row = with_rules(F.coalesce(F.col(text), F.lit("")), ROW_RULES)
    pieces = rows.withColumn("_r", row).select("*", F.posexplode(split_turns(F.col("_r.text"))).alias("part", "_piece"))
    done = pieces.withColumn("_t", with_rules(F.col("_piece"), TURN_RULES)).filter(has_content(F.col("_t.text")))
    return done.select(*rows.columns, "part", F.col("_t.text").alias("clean_text"), F.array_distinct(F.concat("_r.rules", "_t.rules")).alias("text_rules"))
