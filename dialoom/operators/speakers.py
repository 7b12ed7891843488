"""Speaker labels: tidying, casing variants, aliases, several names in one label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SPACE, Rule, with_rules

TIDY: list[Rule] = [
    ("whitespace", lambda c: F.trim(F.regexp_replace(c, SPACE + "+", " "))),
    ("unwrap_parens", lambda c: F.trim(F.regexp_replace(c, r"^\((.*)\)$", "$1"))),
    ("numbered_extra", lambda c: F.regexp_replace(c, r"^(.*?[A-Za-z])\s*#?\s*(\d+)$", "$1 $2")),
]


def tidy_label(c: Column) -> Column:
    """Struct (text, rules)."""
    return with_rules(c, TIDY)


def split_label(c: Column) -> Column:
    return F.filter(F.split(c, r"\s*(?:,|&|\band\b)\s*"), lambda x: x != "")


def casing_errors(c: Column) -> Column:
    """Lower-case word starts and capitals within words."""
    words = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    one = lambda w: F.when(w.rlike("^[a-z]"), 1).otherwise(0) + F.length(F.regexp_replace(F.substr(w, F.lit(2), F.length(w)), "[^A-Z]", ""))
    return F.aggregate(F.transform(words, one), F.lit(0), lambda a, x: a + x)


def label_counts(labels: DataFrame, column: str = "speaker_raw") -> DataFrame:
    """(name, n): names of all labels, tidied again after the split."""
    names = labels.select(F.explode(split_label(tidy_label(F.coalesce(F.col(column), F.lit("")))["text"])).alias("part"))
    return names.select(tidy_label(F.col("part"))["text"].alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def case_map(counts: DataFrame) -> DataFrame:
    """(variant, best) of names that differ from the best casing of their group: fewest errors, then most frequent."""
    by = Window.partitionBy(F.lower("name")).orderBy("errors", F.desc("n"), "name")
    best = counts.withColumn("errors", casing_errors(F.col("name"))).withColumn("best", F.first("name").over(by))
    return best.filter(F.col("name") != F.col("best")).select(F.col("name").alias("variant"), "best")


def resolve(names: DataFrame, cases: DataFrame, scoped: DataFrame, everywhere: DataFrame) -> DataFrame:
    """``names`` (season, episode, name, ...) with ``resolved`` and ``rules``: casing, then the episode's alias, else the general one.

    ``scoped``: season, episode, from_name, to_name; ``everywhere``: from_name, to_name. Aliases are not chained.
    """
    cased = names.join(cases, names["name"] == cases["variant"], "left").withColumn("_cased", F.coalesce("best", "name"))
    s = scoped.select(F.col("season").alias("_s"), F.col("episode").alias("_e"), F.col("from_name").alias("_f"), F.col("to_name").alias("_scoped"))
    g = everywhere.select(F.col("from_name").alias("_g"), F.col("to_name").alias("_global"))
    both = cased.join(s, (F.col("season") == F.col("_s")) & (F.col("episode") == F.col("_e")) & (F.col("_cased") == F.col("_f")), "left").join(g, F.col("_cased") == F.col("_g"), "left")
    rules = F.array_compact(F.array(F.when(F.col("best").isNotNull(), F.lit("case_variant")), F.when(F.col("_scoped").isNotNull(), F.lit("episode_alias")).when(F.col("_global").isNotNull(), F.lit("alias"))))
    return both.select(*names.columns, F.coalesce("_scoped", "_global", "_cased").alias("resolved"), rules.alias("rules"))


def normalize_speakers(rows: DataFrame, key: str, cases: DataFrame, scoped: DataFrame, everywhere: DataFrame) -> DataFrame:
    """``rows`` (key, season, episode, speaker_raw) to key, speaker (null if blank), speakers, speaker_rules."""
    tidied = rows.select(key, "season", "episode", tidy_label(F.coalesce(F.col("speaker_raw"), F.lit(""))).alias("t"))
    parts = tidied.select(key, "season", "episode", F.col("t.rules").alias("_r"), split_label(F.col("t.text")).alias("_p"))
    each = parts.select(key, "season", "episode", "_r", F.size("_p").alias("_n"), F.posexplode_outer("_p").alias("_i", "_part"))
    each = each.withColumn("_t", tidy_label(F.coalesce("_part", F.lit(""))))
    named = resolve(each.withColumn("name", F.when(F.col("_part").isNotNull(), F.col("_t.text"))), cases, scoped, everywhere)
    gathered = named.groupBy(key).agg(F.first("_r").alias("_r"), F.first("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_i", "resolved", F.concat("_t.rules", "rules").alias("rules")))).alias("_all"))
    names = F.array_distinct(F.transform(F.filter("_all", lambda x: x["resolved"].isNotNull()), lambda x: x["resolved"]))
    rules = F.array_distinct(F.concat("_r", F.when(F.col("_n") > 1, F.array(F.lit("multi_speaker"))).otherwise(F.array().cast("array<string>")), F.flatten(F.transform("_all", lambda x: x["rules"]))))
    return gathered.select(key, names.alias("speakers"), rules.alias("speaker_rules")).select(key, F.when(F.size("speakers") > 0, F.array_join("speakers", " & ")).alias("speaker"), "speakers", "speaker_rules")
