"""Removal of repeated passages, by prefix-free parsing of the corpus's bytes.

A byte goes if a ``length``-byte string that covers it also starts earlier (smaller doc_id, or the
same document further left). Gram hashes cut every text into phrases: a trigger is the place of the
least gram hash (leftmost on ties) among the grams of some ``length``-byte window. A window's trigger
depends on the window alone, so equal windows have equal trigger grams at equal offsets; and a window is
a suffix of the phrase before its trigger, followed by what the parse has from the trigger on.

So the corpus order of all windows is made of two suffix arrays, bucket by bucket of trigger grams. The
dictionary's has the phrase suffixes that end at the gram (its left sides, read backwards); the parse's
has the suffixes of the parse that start there (its right sides, over as many phrases as ``length`` bytes
take). Both are sorted on the bytes themselves, with the lengths of common prefixes of neighbours. For each
offset of the trigger, windows are equal where neither array has a shorter common prefix between them;
the first of the class in the corpus stays, the others are repeats.

Only what can repeat gets there. The context of a trigger is the bytes of all windows that share it;
contexts are grouped by 128-bit fingerprints first: all but the first occurrence of a context are
repeats as a whole, the contexts of a gram that has just one of them are unique, and only the first
occurrences of the others are fetched and sorted.

Hot grams are split before any shuffle: occurrences of a context are combined within each task, and
grams that have many contexts in a sample of the documents are dealt by context instead of by gram; so
are, later, all grams with more than ``contexts`` contexts. Their windows are compared one by one in a
shuffled join on 128-bit fingerprints. The sample decides only how rows are dealt, never the result.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep all; rows with a null
id keep all and repeat nothing; rows that share an id must be equal, and none of them repeats
another; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import lean, mixed, numbers, range_hashes
from .common import Scratch, bound_batches, ship_by_value

ship_by_value(__name__)


@dataclass(frozen=True)
class RepeatConfig:
    length: int = 100
    #: Bytes of a gram, a multiple of 8.
    gram: int = 24
    #: Contexts of one gram that one task compares; above, its windows are joined by shuffle.
    contexts: int = 20_000
    #: Rows that a task combines before they are shuffled.
    combine: int = 500_000
    #: Documents that are sampled for hot grams (more with many shuffle partitions), and at most so large a share.
    sample: int = 10_000
    share: float = 0.25
    #: A gram is hot from so many contexts in the sample on, and this share of an average partition.
    hot: int = 16
    even: float = 0.5


#: Window starts of a piece of a text (a longer text is cut into pieces that overlap), and of a block.
_PIECE, _BLOCK, _POSITION = 1 << 22, 1 << 20, 26


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (text number, offset, bytes): all texts that have a window, long ones in pieces."""
    block: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        for offset in range(0, max(0, len(text) - length + 1), _PIECE):
            part = text[offset : offset + _PIECE + length - 1]
            if block and size + len(part) > _BLOCK:
                yield block
                block, size = [], 0
            block.append((number, offset, part))
            size += len(part)
    if block:
        yield block


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(-1, width)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def contexts(block: list[tuple[int, int, bytes]], config: RepeatConfig) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one trigger: text number, first start, number of windows, bytes before the trigger, gram, context."""
    k1, k2, *factors = numbers(2 + config.gram // 8, 8)
    lengths = np.array([len(p[2]) for p in block])
    at = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(p[2] for p in block), dtype=np.uint8)
    n = len(data) - config.gram + 1
    grams = np.zeros(n, dtype=np.uint64)
    for k, factor in enumerate(factors):
        grams += np.ndarray(n, dtype="<u8", buffer=data.data, offset=8 * k, strides=(1,)) * factor
    grams = mixed(grams)
    shift, place = np.uint64(_POSITION), np.arange(n, dtype=np.uint64)
    least = sliding_least((grams >> shift << shift) | place, config.length - config.gram + 1)
    trigger = (least & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    valid = np.ones(len(trigger), dtype=bool)
    for end in at[1:-1]:  # no window crosses the end of a piece
        valid[end - config.length + 1 : end] = False
    starts = np.flatnonzero(valid)
    runs = np.flatnonzero(np.concatenate(([True], (np.diff(trigger[starts]) != 0) | (np.diff(starts) != 1))))
    first, last = starts[runs], starts[np.concatenate((runs[1:], [len(starts)])) - 1]
    trigger = trigger[first]
    piece = np.searchsorted(at, first, side="right") - 1
    context = mixed(range_hashes(data, first, last + config.length) + (trigger - first).astype(np.uint64) * k1 + (last - first).astype(np.uint64) * k2)
    number = np.array([p[0] for p in block])[piece]
    return number, first - at[piece] + np.array([p[1] for p in block])[piece], last - first + 1, trigger - first, grams[trigger], context


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges joined where they touch or overlap within a document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    rank = np.cumsum(new_doc)
    step = np.int64(max(int(end.max()) + 1, 1))
    reach = np.maximum.accumulate(end + rank * step) - rank * step
    new = new_doc | np.concatenate(([True], start[1:] > reach[:-1]))
    heads = np.flatnonzero(new)
    return doc[heads], start[heads], np.maximum.reduceat(end, heads)


def later(key: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in the order of key, doc, start: whether each begins its key, and whether it is later than that first."""
    new = np.zeros(len(doc), dtype=bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    return new, (doc != doc[head]) | (start != start[head])


def _span(start: np.ndarray, length: np.ndarray, dup: bool) -> np.ndarray:
    return (start.astype(np.int64) << 32) | (length.astype(np.int64) << 1) | int(dup)


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names.split())


def _found(batches: Iterator[pa.RecordBatch], config: RepeatConfig) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, text) to document, first start, number of windows, bytes before the trigger, gram and context, in pieces of ``combine`` rows or more."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        for block in pieces([t or b"" for t in texts], config.length):
            number, *rest = contexts(block, config)
            held.append((ids[number].astype(np.int64), *rest))
            if sum(len(x[0]) for x in held) >= config.combine:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _grams(batches: Iterator[pa.RecordBatch], config: RepeatConfig) -> Iterator[pa.RecordBatch]:
    for _, _, _, _, gram, context in _found(batches, config):
        yield _batch("g c", gram, context)


def _parse(batches: Iterator[pa.RecordBatch], config: RepeatConfig, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc, text) to (g, k, c, doc, span): first occurrences of contexts within the task's rows, and ranges that repeat in them. k: 0, or the context if its gram is hot."""
    for doc, start, n, before, gram, context in _found(batches, config):
        order = np.lexsort((start, doc, context, gram))
        doc, start, n, before, gram, context = (x[order] for x in (doc, start, n, before, gram, context))
        new, dup = later([gram, context], doc, start)
        dealt = np.where(np.isin(gram, hot), context | np.uint64(1), np.uint64(0))
        yield _batch("g k c doc span", gram[new], dealt[new], context[new], doc[new], _span(start[new], (before << 8 | n)[new], False))
        d, s, e = merged(doc[dup], start[dup], (start + n - 1 + config.length)[dup])
        yield _batch("g k c doc span", mixed(d.astype(np.uint64)), np.zeros(len(d), dtype=np.int64), np.zeros(len(d), dtype=np.int64), d, _span(s, e - s, True))


#: What a row of _classes is: an occurrence to be compared with others of its gram, one of a hot gram, or a range that repeats.
SOME, HOT, DUP = 0, 1, 2


def _classes(batches: Iterator[pa.RecordBatch], config: RepeatConfig) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, c, doc, span) to (kind, g, doc, start, size): repeats, and one row for each of several contexts of a gram (size: as packed).

    Holds two rows between batches: the open context, and the last representative, whose gram may go on.
    """
    names = "kind g doc start size"
    pending: tuple[np.ndarray, ...] | None = None
    head: tuple[int, ...] | None = None
    several = False
    kinds = lambda n, kind: np.full(n, kind, dtype=np.int32)
    for batch in batches:
        g, k, c, doc, span = (batch.column(i).to_numpy() for i in range(5))
        start, size, dup = span >> 32, (span & 0xFFFFFFFF) >> 1, (span & 1).astype(bool)
        yield _batch(names, kinds(dup.sum(), DUP), g[dup], doc[dup], start[dup], size[dup])
        g, k, c, doc, start, size = (x[~dup] for x in (g, k, c, doc, start, size))
        if not len(g):
            continue
        if head is not None:  # the context that was open before is the first row here too
            g, k, c, doc, start, size = (np.concatenate(([h], x)) for h, x in zip(head, (g, k, c, doc, start, size), strict=True))
        new, repeat = later([g, c], doc, start)
        if head is not None:
            new[0] = repeat[0] = False
        if new.any():
            last = np.flatnonzero(new)[-1]
            head = tuple(int(x[last]) for x in (g, k, c, doc, start, size))
        d, s, e = merged(doc[repeat], start[repeat], (start + (size & 255) - 1 + config.length)[repeat])
        yield _batch(names, kinds(len(d), DUP), np.zeros(len(d), dtype=np.int64), d, s, e - s)
        rep = tuple(x[new] for x in (g, k, doc, start, size))
        if pending is not None:
            rep = tuple(np.concatenate((p, x)) for p, x in zip(pending, rep, strict=True))
        if len(rep[0]) < 2:
            pending = rep if len(rep[0]) else pending
            continue
        same = rep[0][1:] == rep[0][:-1]
        edge = np.concatenate(([several], same)) | np.concatenate((same, [False])) | (rep[1] != 0)
        several = bool(same[-1])
        edge[-1] = False
        yield _batch(names, np.where(rep[1][edge] != 0, HOT, SOME).astype(np.int32), *(rep[i][edge] for i in (0, 2, 3, 4)))
        pending = tuple(x[-1:] for x in rep)
    if pending is not None and (several or pending[1][0] != 0):
        yield _batch(names, kinds(1, HOT if pending[1][0] != 0 else SOME), *(pending[i] for i in (0, 2, 3, 4)))


def _cut(batches: Iterator[pa.RecordBatch], config: RepeatConfig) -> Iterator[pa.RecordBatch]:
    """(doc, text, edges) to (kind, g, doc, start, before, context): the bytes of each edge's context, at most 10,000 at once."""

    def cut() -> Iterator[tuple]:
        for batch in batches:
            for doc, text, edges in zip(*(batch.column(i) for i in range(3)), strict=True):
                whole, name = (text.as_py() or "").encode(), doc.as_py()
                for edge in edges.values:
                    e = edge.as_py()
                    start, n = e["start"], e["size"] & 255
                    yield e["kind"], e["g"], name, start, e["size"] >> 8, whole[start : start + n - 1 + config.length]

    for rows in batched(cut(), 10_000):
        columns = zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["kind", "g", "doc", "start", "before", "context"])


def suffix_order(bucket: np.ndarray, strings: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of padded byte strings (one a row) within their buckets, and the common prefix of each with its predecessor (-1: another bucket)."""
    n, width = strings.shape
    eights = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    eights[:, :width] = strings
    order = np.lexsort((sizes, *eights.view(">u8").astype(np.uint64).T[::-1], bucket))
    s, b, k = strings[order], bucket[order], sizes[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(k[1:], k[:-1]))
    return order, np.concatenate(([-1], np.where(b[1:] == b[:-1], common, -1)))


def equal_windows(table: pa.Table, config: RepeatConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (g, doc, start, before, context) of whole grams to ranges (document, start, end) of windows that are not the first of their class."""
    g, doc, start, before = (table.column(i).to_numpy() for i in range(4))
    text = table.column(4).to_pylist()
    order = np.lexsort((start + before, doc))  # corpus order of the triggers
    g, doc, start, before = g[order], doc[order], start[order], before[order]
    text = [text[i] for i in order]
    size = np.array([len(t) for t in text])
    flat, at = np.frombuffer(b"".join(text), dtype=np.uint8), np.concatenate(([0], np.cumsum(size)))[:-1]
    reach = config.length - config.gram
    left, right = np.arange(reach), np.arange(config.length)
    trigger = (at + before)[:, None]
    lefts = np.where(left < before[:, None], flat[np.maximum(trigger - 1 - left, 0)], np.uint8(0))
    rights = np.where(right < (size - before)[:, None], flat[np.minimum(trigger + right, len(flat) - 1)], np.uint8(0))
    by_phrase, left_common = suffix_order(g, lefts, before)
    by_parse, right_common = suffix_order(g, rights, size - before)
    first = before - (size - config.length)  # the least distance of a window's start from the trigger
    phrase, parse = np.empty(len(g), dtype=np.int64), np.empty(len(g), dtype=np.int64)
    docs, starts = [], []
    for back in range(reach + 1):
        live = np.flatnonzero((first <= back) & (back <= before))
        if len(live) > 1:
            phrase[by_phrase] = np.cumsum(left_common < back)
            parse[by_parse] = np.cumsum(right_common < config.length - back)
            key = phrase[live] * (len(g) + 1) + parse[live]
            by_key = np.argsort(key, kind="stable")
            live = live[by_key]
            place = (start + before)[live]
            _, dup = later([key[by_key]], doc[live], place)
            docs.append(doc[live[dup]])
            starts.append(place[dup] - back)
    if not docs:
        return (np.zeros(0, dtype=np.int64),) * 3
    d, s = np.concatenate(docs), np.concatenate(starts)
    return merged(d, s, s + config.length)


def _compare(batches: Iterator[pa.RecordBatch], config: RepeatConfig) -> Iterator[pa.RecordBatch]:
    """Rows (g, doc, start, before, context) sorted by g to (doc, start, n): ranges of windows that are not their gram's first."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        g = table.column(0).to_numpy()
        ends = np.flatnonzero(g[1:] != g[:-1]) + 1
        done = int(ends[-1]) if len(ends) else 0  # the last gram may go on in the next batch
        held = table.slice(done)
        if done:
            d, s, e = equal_windows(table.slice(0, done), config)
            yield _batch("doc start n", d, s, e - s)
    if held is not None and len(held):
        d, s, e = equal_windows(held, config)
        yield _batch("doc start n", d, s, e - s)


def _windows(batches: Iterator[pa.RecordBatch], config: RepeatConfig) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows (g, doc, start, before, context) to gram, fingerprint, document and start of all their windows, in pieces of ``combine`` rows or more."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if batch.num_rows:
            g, doc, start = (batch.column(i).to_numpy() for i in range(3))
            context = batch.column(4).to_pylist()
            counts = np.array([len(c) - config.length + 1 for c in context])
            at = np.concatenate(([0], np.cumsum([len(c) for c in context])))[:-1]
            of = np.repeat(np.arange(len(context)), counts)
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = at[of] + within
            window = range_hashes(np.frombuffer(b"".join(context), dtype=np.uint8), begin, begin + config.length)
            held.append((g[of], window.view(np.int64), doc[of], start[of] + within))
            if sum(len(x[0]) for x in held) >= config.combine:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _spread(batches: Iterator[pa.RecordBatch], config: RepeatConfig) -> Iterator[pa.RecordBatch]:
    """Rows (g, doc, start, before, context) to (g, window, doc, start, n): the first of each window within the task's rows (n: 0), and ranges that repeat in them."""
    for g, window, doc, start in _windows(batches, config):
        order = np.lexsort((start, doc, window, g))
        g, window, doc, start = (x[order] for x in (g, window, doc, start))
        new, dup = later([g, window], doc, start)
        yield _batch("g window doc start n", g[new], window[new], doc[new], start[new], np.zeros(new.sum(), dtype=np.int64))
        d, s, e = merged(doc[dup], start[dup], start[dup] + config.length)
        none = np.zeros(len(d), dtype=np.int64)
        yield _batch("g window doc start n", none, none, d, s, e - s)


def hot_grams(texts: DataFrame, config: RepeatConfig) -> np.ndarray:
    """Grams that would crowd a partition, by a sample of the documents: they are dealt otherwise, with the same result. At most two for each partition."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(config.share, max(config.sample, 100 * partitions) / max(1, texts.count()))
    seen = texts.sample(share, seed=1).mapInArrow(lean(lambda b: _grams(b, config)), "g long, c long")
    counts = seen.groupBy("g").agg(F.count_distinct("c").alias("n"))
    told = counts.agg(F.sum("n").alias("all"), F.collect_list(F.when(F.col("n") >= config.hot, F.struct("g", "n"))).alias("found")).first()
    least = (told["all"] or 0) * config.even / partitions
    return np.array(sorted(r["g"] for r in told["found"] if r["n"] >= least), dtype=np.int64).view(np.uint64)


def repeated_ranges(docs: DataFrame, config: RepeatConfig, scratch: Scratch) -> DataFrame:
    """(doc, ranges): the byte ranges (start, n) to remove, of the documents that have any; ranges may overlap."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    hot = hot_grams(texts, config)
    parse = texts.mapInArrow(lean(lambda b: _parse(b, config, hot)), "g long, k long, c long, doc long, span long")
    parse = parse.repartition("g", "k").sortWithinPartitions("g", "c", "doc", "span")
    found = scratch.keep(parse.mapInArrow(lean(lambda b: _classes(b, config)), "kind int, g long, doc long, start long, size long"), "found")
    edges = found.filter(F.col("kind") != DUP)
    by_doc = edges.groupBy("doc").agg(F.collect_list(F.struct("kind", "g", "start", "size")).alias("edges"))
    cut = texts.join(by_doc, "doc").select("doc", "text", "edges").mapInArrow(lean(lambda b: _cut(b, config)), "kind int, g long, doc long, start long, before long, context binary")
    rows = ["g", "doc", "start", "before", "context"]
    copies = texts.groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")  # rows that share an id are cut one by one
    crowds = edges.join(copies, "doc", "left").groupBy("g").agg(F.sum(F.coalesce("rows", F.lit(1))).alias("n"), F.max("kind").alias("kind"))
    many = scratch.keep(crowds.filter((F.col("n") > config.contexts) | (F.col("kind") == HOT)).select("g"), "many")
    crowded = not many.isEmpty()
    cut = scratch.keep(cut, "cut") if crowded else cut  # read twice
    few = (cut.join(many, "g", "left_anti") if crowded else cut).select(rows).repartition("g").sortWithinPartitions("g")
    ranges = found.filter(F.col("kind") == DUP).select("doc", "start", F.col("size").alias("n")).unionByName(few.mapInArrow(lean(lambda b: _compare(b, config)), "doc long, start long, n long"))
    if crowded:
        spread = cut.join(many, "g", "left_semi").select(rows).mapInArrow(lean(lambda b: _spread(b, config)), "g long, window long, doc long, start long, n long")
        spread = scratch.keep(spread, "spread")
        first = spread.filter("n = 0").groupBy("g", "window").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
        beyond = spread.filter("n = 0").join(first, ["g", "window"]).filter(F.struct("doc", "start") > F.col("first"))
        ranges = ranges.unionByName(spread.filter("n > 0").select("doc", "start", "n")).unionByName(beyond.select("doc", "start", F.lit(config.length).cast("long").alias("n")))
    out = scratch.keep(ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("ranges")), "ranges")
    scratch.drop_but(out)
    return out


def _kept(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            whole, left, spans, at, removed = (text or "").encode(), [], 0, 0, 0
            for start, end in sorted((r["start"], r["start"] + r["n"]) for r in ranges or ()):
                if start > at or not spans:  # ranges that touch are one span
                    left.append(whole[at:start])
                    spans += 1
                    at = start
                removed += max(0, end - at)
                at = max(at, end)
            rest = b"".join([*left, whole[at:]])
            out.append((len(whole), removed, spans, hashlib.sha256(rest).hexdigest(), rest if texts else None))
        n, r, s, h, t = zip(*out, strict=True) if out else ((),) * 5
        arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())]
        yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(t, pa.binary())] if texts else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])


def remove_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig(), scratch: Scratch | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if ``texts``) the bytes that are kept, of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    bound_batches(docs.sparkSession)
    ranges = repeated_ranges(docs, config, scratch)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = own.join(ranges.withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return joined.mapInArrow(lean(lambda b: _kept(b, texts)), schema)
