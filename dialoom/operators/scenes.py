"""Scene inference from speaker turnover and transition phrases: metadata only.

``lines``: ep (an episode's key), i (its line number from 0), speakers, clean_text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Scenes


def speaker_weights(lines: DataFrame) -> DataFrame:
    """(ep, name, w): the logarithm of all mentions over the name's."""
    n = lines.select("ep", F.explode("speakers").alias("name")).groupBy("ep", "name").agg(F.count(F.lit(1)).alias("n"))
    return n.select("ep", "name", F.log(F.sum("n").over(Window.partitionBy("ep")) / F.col("n")).alias("w"))


def _side(before: bool, window: int) -> Column:
    w = Window.partitionBy("ep").orderBy("i")
    frame = w.rowsBetween(-window, -1) if before else w.rowsBetween(0, window - 1)
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list("speakers").over(frame))))


def similarities(lines: DataFrame, window: int = 6) -> DataFrame:
    """(ep, i, similarity): weighted overlap of the speakers before and after each line; null at the start or without speakers."""
    weights = speaker_weights(lines).groupBy("ep").agg(F.map_from_entries(F.collect_list(F.struct("name", "w"))).alias("ws"))
    sides = lines.select("ep", "i", _side(True, window).alias("a"), _side(False, window).alias("b")).join(weights, "ep", "left")
    weigh = lambda names: F.aggregate(names, F.lit(0.0), lambda s, x: s + F.col("ws")[x])
    both, either = weigh(F.array_sort(F.array_intersect("a", "b"))), weigh(F.array_sort(F.array_union("a", "b")))
    value = F.when(either == 0, F.lit(1.0)).otherwise(both / either)
    return sides.select("ep", "i", F.when((F.col("i") > 0) & (F.size("a") > 0) & (F.size("b") > 0), value).alias("similarity"))


def candidates(lines: DataFrame, config: Scenes = Scenes()) -> DataFrame:
    """(ep, i, strength, signals, similarity): turnover and transitions, merged.

    Similarities are compared at 9 places, so that equal ones of other speakers stay equal.
    """
    w = Window.partitionBy("ep").orderBy("i")
    far = F.lit(float("inf"))
    near = similarities(lines, config.window).withColumn("similarity", F.round("similarity", 9)).withColumn("_b", F.coalesce(F.lag("similarity").over(w), far)).withColumn("_a", F.coalesce(F.lead("similarity").over(w), far))
    s = F.col("similarity")
    turnover = near.filter((s <= config.max_similarity) & (s <= F.col("_b")) & (s <= F.col("_a"))).select("ep", "i", (F.lit(1.0 + config.max_similarity) - s).alias("strength"), F.lit(0).alias("kind"), "similarity")
    opens = lines.filter((F.col("i") > 0) & F.col("clean_text").rlike("(?i)" + config.transitions)).select("ep", "i", F.lit(2.0).alias("strength"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("similarity"))
    names = F.array(F.lit("speaker_turnover"), F.lit("transition_phrase"))
    return turnover.unionByName(opens).groupBy("ep", "i").agg(F.sum("strength").alias("strength"), F.transform(F.array_sort(F.collect_list("kind")), lambda k: F.get(names, k)).alias("signals"), F.max("similarity").alias("similarity"))


def accept(found: list[tuple[float, int]], n_lines: int, least: int) -> list[int]:
    """Boundaries taken strongest first (at 9 places, earlier lines first) that leave every scene ``least`` lines."""
    chosen: list[int] = []
    for _, i in sorted((-round(s, 9), i) for s, i in found):
        if least <= i <= n_lines - least and all(abs(i - c) >= least for c in chosen):
            chosen.append(i)
    return sorted(chosen)


def boundaries(lines: DataFrame, config: Scenes = Scenes()) -> DataFrame:
    """(ep, i): the accepted boundaries. The greedy choice is sequential within an episode, over its candidates only."""
    sizes = lines.groupBy("ep").agg(F.count(F.lit(1)).alias("n_lines"))
    kind = lines.schema["ep"].dataType.simpleString()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        chosen = accept(list(zip(frame["strength"], frame["i"], strict=True)), int(frame["n_lines"].iloc[0]), config.min_lines)
        return pd.DataFrame({"ep": [frame["ep"].iloc[0]] * len(chosen), "i": chosen})

    return candidates(lines, config).select("ep", F.col("i").cast("long").alias("i"), "strength").join(sizes, "ep").groupBy("ep").applyInPandas(one, f"ep {kind}, i long")


def scene_numbers(lines: DataFrame, config: Scenes = Scenes()) -> DataFrame:
    """``lines`` with ``scene`` from 1."""
    cut = boundaries(lines, config).withColumn("_open", F.lit(1))
    scene = F.sum(F.coalesce("_open", F.lit(0))).over(Window.partitionBy("ep").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) + 1
    return lines.join(cut, ["ep", "i"], "left").withColumn("scene", scene.cast("long")).drop("_open")


def scenes(lines: DataFrame, config: Scenes = Scenes()) -> DataFrame:
    """One row for each scene: half-open line range, row range, line count, speakers."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("speakers"))))
    return scene_numbers(lines, config).groupBy("ep", "scene").agg(F.min("i").alias("line_start"), (F.max("i") + 1).alias("line_end"), F.min_by("source_row", "i").alias("source_row_start"), F.max_by("source_row", "i").alias("source_row_end"), F.count(F.lit(1)).alias("n_lines"), names.alias("speakers"))
