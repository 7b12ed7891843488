"""Row spans, quotes and where they are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import match_form


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Inclusive ranges that share a row."""
    return (a0 <= b1) & (b0 <= a1)


def span_label(season: Column, episode: Column, start: Column, end: Column) -> Column:
    return F.format_string("S%02dE%02d rows %d-%d", season, episode, start, end)


def span_hits(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans (ep, start, end, ...) joined with the chunks (ep, source_row_start, source_row_end, ...) that they touch."""
    hit = overlap(F.col("start"), F.col("end"), F.col("source_row_start"), F.col("source_row_end"))
    return spans.join(chunks, "ep").filter(hit)


def find_quotes(lines: DataFrame, quotes: DataFrame) -> DataFrame:
    """Places of each quote (quote_id, ep, quote) in its episode's lines (ep, i, source_row, clean_text): quote_id, row_first, row_last.

    Lines in match form are joined with single spaces; matches may overlap and may start inside a word. Only
    the episodes that have quotes to look for are gathered, each as one text. That is cut before every match
    in one pass; running lengths of the pieces are the places, and an as-of window finds their rows.
    """
    wanted = quotes.select("quote_id", "ep", match_form(F.col("quote")).alias("needle")).filter("needle <> ''")
    asked = wanted.select("ep").distinct()
    formed = lines.join(asked, "ep", "left_semi").select("ep", "i", "source_row", match_form(F.col("clean_text")).alias("f"))
    by = Window.partitionBy("ep").orderBy("i")
    placed = formed.withColumn("at", F.coalesce(F.sum(F.length("f") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = placed.groupBy("ep").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda x: x["f"]), " ").alias("text"))
    met = wanted.join(whole, "ep").filter(F.contains("text", F.col("needle")))
    # A match form has letters, digits and spaces only, so the needle is its own pattern.
    cut = met.select("quote_id", "ep", F.length("needle").alias("n"), "needle", F.posexplode(F.split("text", F.concat(F.lit("(?="), F.col("needle"), F.lit(")")))).alias("k", "piece"))
    order = Window.partitionBy("quote_id", "ep").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    found = cut.withColumn("p", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0))).filter((F.col("k") > 0) | F.col("piece").startswith(F.col("needle")))
    ends = found.select("ep", "quote_id", F.col("p").alias("match"), F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("p").alias("at")), F.struct(F.lit(2).alias("side"), (F.col("p") + F.col("n") - 1).alias("at")))).alias("e"))
    none = lambda kind: F.lit(None).cast(kind)
    row = lines.schema["source_row"].dataType
    marks = placed.select("ep", "at", none(quotes.schema["quote_id"].dataType).alias("quote_id"), none("long").alias("match"), F.lit(0).alias("side"), "source_row", F.col("i").cast("long").alias("i"))
    probes = ends.select("ep", F.col("e.at").cast("long").alias("at"), "quote_id", F.col("match").cast("long").alias("match"), F.col("e.side").alias("side"), none(row).alias("source_row"), none("long").alias("i"))
    upto = Window.partitionBy("ep").orderBy("at", "side", "i").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(probes).withColumn("row", F.last("source_row", ignorenulls=True).over(upto)).filter("side > 0")
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("row")))
    return seen.groupBy("quote_id", "ep", "match").agg(at(1).alias("row_first"), at(2).alias("row_last")).select("quote_id", "row_first", "row_last")


def quote_status(spans: DataFrame, found: DataFrame) -> DataFrame:
    """(quote_id, status) of spans (quote_id, start, end, quote): no_quote, ok, moved or missing."""
    met = spans.join(found, "quote_id", "left")
    inside = F.max(F.coalesce((F.col("row_first") >= F.col("start")) & (F.col("row_last") <= F.col("end")), F.lit(False)))
    some = F.max(F.col("row_first").isNotNull())
    return met.groupBy("quote_id", "quote").agg(inside.alias("inside"), some.alias("some")).select("quote_id", F.when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no_quote").when(F.col("inside"), "ok").when(F.col("some"), "moved").otherwise("missing").alias("status"))
