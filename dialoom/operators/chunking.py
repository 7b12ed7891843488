"""Packing of whole lines into overlapping token windows.

``lines``: ep, i (line number from 0), tokens, and what chunks are made of. An episode's counts are
packed together (a few bytes a line); texts are joined afterwards by range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import CorpusError
from ..functions.text import shown_line
from ..shipping import ship_by_value

ship_by_value(__name__)


def cuts(tokens: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (half open) of the windows over lines of so many tokens.

    With ``upto[k]`` the tokens of the first k lines, a window from line s ends at the last e with
    upto[e] - upto[s] <= size (but takes one line at least), and the next one starts at the first line from
    which what is shared leaves room: upto[e] - upto[t] <= min(overlap, size - tokens[e]). Both are looked up
    by bisection.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("needs 0 <= overlap < size")
    upto = np.concatenate(([0], np.cumsum(tokens, dtype=np.int64)))
    starts, ends, at = [], [], 0
    while at < len(tokens):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + size, side="right")) - 1)
        starts.append(at)
        ends.append(end)
        if end == len(tokens):
            break
        shared = min(overlap, size - int(tokens[end]))
        at = min(end, max(at + 1, int(np.searchsorted(upto, upto[end] - shared, side="left"))))
    return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)


def _cut(batches: Iterator[pa.RecordBatch], settings: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(ep, counts) to (ep, size, overlap, chunk, start, stop)."""
    for batch in batches:
        lists = batch.column(1)
        flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        of, made = [], []
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            for size, overlap in settings:
                starts, ends = cuts(flat[a:b], size, overlap)
                of.append(np.full(len(starts), i))
                made.append(np.stack([np.full(len(starts), size), np.full(len(starts), overlap), np.arange(len(starts)), starts, ends]))
        rows = np.concatenate(made, axis=1) if made else np.zeros((5, 0), dtype=np.int64)
        ep = batch.column(0).take(pa.array(np.concatenate(of) if of else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([ep, *[pa.array(x, pa.int64()) for x in rows]], names=["ep", "size", "overlap", "chunk", "start", "stop"])


def windows_of(counts: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """(ep, size, overlap, chunk, start, stop): windows of every setting over (ep, counts), an array of tokens a line."""
    kind = counts.schema["ep"].dataType.simpleString()
    return counts.select("ep", F.col("counts").cast("array<bigint>").alias("counts")).mapInArrow(lambda b: _cut(b, settings), f"ep {kind}, size long, overlap long, chunk long, start long, stop long")


def windows(lines: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """The same over lines (ep, i, tokens), one row each."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "tokens")))
    return windows_of(lines.groupBy("ep").agg(F.transform(ordered, lambda x: x["tokens"]).alias("counts")), settings)


def reopened_episodes(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Episodes whose lines (ep, and their place in the file) aren't one block; chunks of them would mix places."""
    span = lines.groupBy("ep").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    return span.filter(F.col("last") - F.col("first") + 1 > F.col("n")).select("ep")


def chunk_set(lines: DataFrame, titles: DataFrame, settings: list[tuple[int, int]], line_scenes: DataFrame | None = None, unknown: str = "(unknown)") -> DataFrame:
    """Chunks with their episode's title (ep, episode_title; null if there is none) and, with ``line_scenes`` (ep, i, scene), the scenes they touch."""
    if "line_no" in lines.columns and not reopened_episodes(lines).isEmpty():
        raise CorpusError("an episode's lines are not in one block", recovery="order the lines by episode")
    made = chunks(lines, settings, unknown).join(titles.select("ep", "episode_title"), "ep", "left")
    if line_scenes is None:
        return made
    return made.join(attach_scenes(windows(lines, settings), line_scenes), ["ep", "size", "overlap", "chunk"], "left")


def chunks(lines: DataFrame, settings: list[tuple[int, int]], unknown: str = "(unknown)") -> DataFrame:
    """Chunks with id, row range, tokens, line count, speakers in order of appearance, text, and neighbours."""
    cut = windows(lines, settings)
    met = cut.join(lines, "ep").filter((F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop")))
    gathered = met.groupBy("ep", "size", "overlap", "chunk").agg(
        F.min_by("source_row", "i").alias("source_row_start"), F.max_by("source_row", "i").alias("source_row_end"), F.sum("tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("i", "speakers", shown_line(F.col("speaker"), F.col("clean_text"), unknown).alias("t")))).alias("_l"),
    )
    tag = F.format_string("%s-tok%do%d-%03d", F.col("ep").cast("string"), "size", "overlap", "chunk")
    named = gathered.select(tag.alias("chunk_id"), "ep", "size", "overlap", "chunk", "source_row_start", "source_row_end", "n_tokens", "n_lines", F.array_distinct(F.flatten(F.transform("_l", lambda x: x["speakers"]))).alias("speakers"), F.array_join(F.transform("_l", lambda x: x["t"]), "\n").alias("text"))
    by = Window.partitionBy("ep", "size", "overlap").orderBy("chunk")
    return named.withColumn("prev_chunk_id", F.lag("chunk_id").over(by)).withColumn("next_chunk_id", F.lead("chunk_id").over(by))


def attach_scenes(cut: DataFrame, line_scenes: DataFrame) -> DataFrame:
    """(ep, chunk, scenes): scene numbers that each window (ep, size, overlap, chunk, start, stop) overlaps."""
    met = cut.join(line_scenes.select("ep", "i", "scene"), "ep").filter((F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop")))
    return met.groupBy("ep", "size", "overlap", "chunk").agg(F.array_sort(F.collect_set("scene")).alias("scenes"))


def spread(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """least, p10, median, p90, most: the element at min(n - 1, floor(q * n)) of the sorted values.

    Counted by value first, so what is ordered is the distinct values of a key.
    """
    counts = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_c").over(by.orderBy(value))).withColumn("_n", F.sum("_c").over(by))
    at = lambda q: F.min(F.when(F.col("_upto") > F.least(F.col("_n") - 1, F.floor(F.col("_n") * q)), F.col(value)))
    return ranked.groupBy(*keys).agg(F.min(value).alias("least"), at(0.1).alias("p10"), at(0.5).alias("median"), at(0.9).alias("p90"), F.max(value).alias("most"))
