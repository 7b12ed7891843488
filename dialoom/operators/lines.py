"""Rows to cleaned lines, and the summaries of a parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ROW_RULES, TURN_RULES, has_content, line_id, split_turns, with_rules

UNKNOWN_AFTER_SPLIT = "split_turn_speaker_unknown"


def turns(rows: DataFrame, key: str = "csv_record", text: str = "text_raw") -> DataFrame:
    """(key, part, n_parts, clean_text, text_rules): turns with content, numbered from 0."""
    cleaned = rows.select(key, with_rules(F.coalesce(F.col(text), F.lit("")), ROW_RULES).alias("r"))
    pieces = cleaned.select(key, F.col("r.rules").alias("_rr"), F.posexplode(split_turns(F.col("r.text"))).alias("_i", "_piece"))
    done = pieces.withColumn("t", with_rules(F.col("_piece"), TURN_RULES)).filter(has_content(F.col("t.text")))
    by = Window.partitionBy(key)
    placed = done.withColumn("part", F.row_number().over(by.orderBy("_i")) - 1).withColumn("n_parts", F.count(F.lit(1)).over(by).cast("int"))
    rules = F.array_distinct(F.concat("_rr", "t.rules"))
    return placed.select(key, "part", "n_parts", F.col("t.text").alias("clean_text"), F.when(F.col("n_parts") > 1, F.concat(rules, F.array(F.lit("split_turns")))).otherwise(rules).alias("text_rules"))


def build_lines(rows: DataFrame, speakers: DataFrame, keep_label_on_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines, and the rows without content. ``rows``: csv_record, season, episode, source_row, text_raw, ...; ``speakers`` by csv_record."""
    cut = turns(rows)
    own = (F.col("n_parts") == 1) | (F.lit(keep_label_on_first) & (F.col("part") == 0))
    joined = cut.join(rows, "csv_record").join(speakers, "csv_record", "left")
    lines = joined.select(
        line_id(F.col("season"), F.col("episode"), F.col("source_row"), F.col("part")).alias("line_id"), "season", "episode", "source_row", "part", "n_parts", "csv_record", "clean_text", "text_rules",
        F.when(own, F.col("speaker")).alias("speaker"), F.when(own, F.col("speakers")).otherwise(F.array().cast("array<string>")).alias("speakers"),
        F.when(own, F.col("speaker_rules")).otherwise(F.array(F.lit(UNKNOWN_AFTER_SPLIT))).alias("speaker_rules"),
    )
    return lines, rows.join(cut.select("csv_record").distinct(), "csv_record", "left_anti")


def rule_summary(lines: DataFrame, examples: int = 3, key: str = "csv_record") -> DataFrame:
    """(rule, n_rows, examples): distinct rows that a rule changed, and the first texts in row order."""
    each = lines.select(key, "part", "clean_text", F.explode("text_rules").alias("rule"))
    by = Window.partitionBy("rule").orderBy(key, "part")
    shown = each.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= examples)
    shown = shown.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "clean_text"))), lambda x: x["clean_text"]).alias("examples"))
    return each.groupBy("rule").agg(F.count_distinct(key).alias("n_rows")).join(shown, "rule")


def speaker_mappings(lines: DataFrame) -> DataFrame:
    """(speaker_raw, speaker, rules, n) of first parts whose label a rule changed, other than by whitespace alone."""
    rules = F.array_join("speaker_rules", ",")
    first = lines.filter((F.col("part") == 0) & (F.size("speaker_rules") > 0) & ~F.array_contains("speaker_rules", UNKNOWN_AFTER_SPLIT) & (rules != "whitespace"))
    return first.groupBy(F.trim("speaker_raw").alias("speaker_raw"), "speaker", rules.alias("rules")).agg(F.count(F.lit(1)).alias("n"))


def split_summary(lines: DataFrame) -> DataFrame:
    return lines.filter("n_parts > 1").agg(F.count_distinct("csv_record").alias("n_rows"), F.count(F.lit(1)).alias("n_lines"))


def top_speakers(lines: DataFrame, n: int = 20, order: str = "line_no") -> DataFrame:
    """(speaker, n), the most frequent first, ties by first appearance."""
    counted = lines.select(F.explode("speakers").alias("speaker"), order).groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(n)


def group_counts(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def count_spread(counts: DataFrame) -> DataFrame:
    return counts.agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))
