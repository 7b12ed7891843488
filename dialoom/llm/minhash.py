"""Near-duplicate documents by an inverted join of signature coordinates.

A signature has ``coordinates`` minima. A document is posted under each (coordinate, value) of it, and
the collisions of a pair, the coordinates in which it agrees, are counted: pairs with fewer than
``least`` are dropped, the others are verified on their full sets. Two sets of similarity 0.85 agree
in fewer than 39 of 64 coordinates with a chance of 6e-7, more similar ones with less.

Prefix merging: a pair that agrees in ``least`` values agrees in one of the rarest of each document's
shared values, all but least - 1 of them, so only these lists are merged. Skip merging: values of one
document alone, and documents with fewer than ``least`` shared values, are skipped; the long lists
beyond the prefix are never merged, their part of the count is looked up in the signatures (one byte a
coordinate, so a count is never too small).

Lists are never expanded into all pairs, and none is capped. Documents with equal shingle sets are one
class from the start. In the first round every list names two leaders; the rest of the list is counted
against them, what is retained is verified, and links are merged into components. A list whose
documents are all in one component is done, and so are its leaders. In the documents of the others,
shingles that only one of them has bound every similarity from above: a document with too many leaves,
and pairs with too many are passed over. Then a list of at most ``small`` documents compares all its
pairs from different components. Longer ones that overlap so much that their union takes fewer
comparisons than they do become one list; a long list names 8, then 32 leaders from its smallest
components, and what it still has is compared in blocks: the documents outside its largest component,
in blocks of bounded size, against all of its documents. After that each two documents of a list were compared, are
in one component or too far apart, so four rounds do at any size.
Verification streams the sets of the one side past an index of the other's, dealt by leader and salt
(or block), so that no leader, list or component meets in one task.

Shingles are 64-bit numbers made of word hashes without structural collisions (see bytehash), so full
sets are compared up to chance: two different shingles are taken as equal with one of 2**-63.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle; null ids link with nothing, have a null component and are kept;
rows that share an id are one document (its texts are taken to be equal); an empty table gives an empty result; only doc_id and text
are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytehash import blocks, lean, mixed, numbers, range_hashes
from .common import Bitmap, Scratch, bound_batches, ship_by_value, without

ship_by_value(__name__)


@dataclass(frozen=True)
class NearConfig:
    words: int = 5
    #: Linked: 100 * intersection >= percent * union.
    percent: int = 85
    coordinates: int = 64
    #: The match threshold.
    least: int = 39
    #: Coordinates that tell the documents without any possible partner; more than coordinates - least.
    first: int = 40
    #: Leaders of a list in the first rounds.
    leaders: tuple[int, ...] = (2, 8, 32)
    #: Lists up to this length are compared pair by pair after the first round.
    small: int = 64
    #: Documents of a block, shingles of a block, and documents that one task compares with it.
    block: int = 256
    block_shingles: int = 500_000
    reach: int = 512
    #: Links whose components one task finds; more are joined by stars.
    last_links: int = 300_000


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are cut at the ASCII whitespace, A-Z are lower-cased."""
    coefficients = numbers(width + 1, 2)
    data = np.frombuffer(b" ".join(texts).lower() + b" ", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[data].view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    word = range_hashes(data, starts, ends)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    n = max(0, len(word) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled += word[k : k + n] * coefficients[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(distinct(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mixed((word[a:b] * coefficients[: b - a]).sum(keepdims=True, dtype=np.uint64) + coefficients[width:] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: coordinate values (one row a set; values of different coordinates never meet) and two sums that identify the set."""
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    whole = np.concatenate(sets)
    factors, salts = numbers(coordinates, 3), numbers(coordinates, 4)
    values = np.empty((len(sets), coordinates), dtype=np.uint64)
    scratch = np.empty_like(whole)
    for c in range(coordinates):
        np.multiply(whole, factors[c], out=scratch)
        values[:, c] = mixed(np.minimum.reduceat(scratch, offsets) ^ salts[c])
    keys = np.stack([np.add.reduceat(mixed(whole ^ s), offsets) for s in numbers(2, 5)], axis=1)
    return values, keys


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch], config: NearConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch.column(1))
        for start, end in blocks(texts):
            sets = shingle_sets(texts[start:end], config.words)
            full = [i for i, s in enumerate(sets) if len(s)]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            keys = np.zeros((len(sets), 2), dtype=np.uint64)
            lists = np.zeros(0, dtype=np.uint64)
            if full:
                values, keys[full] = signatures([sets[i] for i in full], config.coordinates)
                lists = values.ravel()
            counts = np.where(sizes > 0, config.coordinates, 0)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, end - start), pa.array(sizes), *[pa.array(keys[:, i].astype(np.int64)) for i in (0, 1)], pa.ListArray.from_arrays(offsets, pa.array(lists.view(np.int64)))],
                names=["doc_id", "n_shingles", "k1", "k2", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch], config: NearConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch.column(1))
        for start, end in blocks(texts):
            sets = shingle_sets(texts[start:end], config.words)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
            whole = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(offsets, pa.array(whole.view(np.int64)))], names=["doc", "shingles"])


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, sig) to (doc, low): one byte of each coordinate."""
    for batch in batches:
        sig = batch.column(1)
        values = sig.flatten().to_numpy().view(np.uint64).astype(np.uint8)
        width = len(values) // max(1, len(sig))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in values.reshape(len(sig), width)], pa.binary())], names=["doc", "low"])


def _matrix(low: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join([*low.to_pylist(), b"\0"]), dtype=np.uint8)[:-1].reshape(len(low), coordinates)


def _counted(batches: Iterator[pa.RecordBatch], config: NearConfig) -> Iterator[pa.RecordBatch]:
    """(lead, doc, lead_low, low, lead_comp, comp) to the pairs (lead, doc, lead_comp, comp) with enough collisions."""
    for batch in batches:
        same = _matrix(batch.column(2), config.coordinates) == _matrix(batch.column(3), config.coordinates)
        kept = pa.array(same.sum(axis=1) >= config.least)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(kept) for i in (0, 1, 4, 5)], names=["lead", "doc", "lead_comp", "comp"])


def _paired(batches: Iterator[pa.RecordBatch], config: NearConfig) -> Iterator[pa.RecordBatch]:
    """Rows (tok, doc, comp, low, size, own) sorted by tok, of short lists, to the pairs with enough collisions, different components and few enough shingles of their own."""
    held: pa.Table | None = None

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tok, doc, comp = (table.column(i).to_numpy() for i in range(3))
        low = _matrix(table.column(3), config.coordinates)
        size, own = (table.column(i).to_numpy() for i in (4, 5))
        edges = np.concatenate(([0], np.flatnonzero(tok[1:] != tok[:-1]) + 1, [len(tok)]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i, j = np.triu_indices(b - a, 1)
            i, j = i + a, j + a
            most = np.minimum((size - own)[i], (size - own)[j])
            open_ = (comp[i] != comp[j]) & (most * 100 >= (size[i] + size[j] - most) * config.percent)
            i, j = i[open_], j[open_]
            near = (low[i] == low[j]).sum(axis=1) >= config.least
            i, j = i[near], j[near]
            swap = doc[i] > doc[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[i], doc[j], comp[i], comp[j])], names=["lead", "doc", "lead_comp", "comp"])

    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        tok = table.column(0).to_numpy()
        ends = np.flatnonzero(tok[1:] != tok[:-1])
        done = int(ends[-1]) + 1 if len(ends) else 0  # the last list may go on in the next batch
        if done:
            yield from pairs(table.slice(0, done))
        held = table.slice(done)
    if held is not None and len(held):
        yield from pairs(held)


#: Places in an index that are held at once, or those of one shingle.
PLACES = 1 << 18


class Index:
    """The sets of some documents, to be compared with others one after another."""

    def __init__(self, docs: list[int], comps: list[int], sets: list[np.ndarray], percent: int) -> None:
        self.docs, self.percent = docs, percent
        self.comps = np.array(comps, dtype=np.int64)
        self.sizes = np.array([len(s) for s in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            x = up
        return x

    def links(self, docs: list[int], comps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """(indexed document, document) of pairs that are similar enough; no more than join their components."""
        n, out = len(self.docs), []
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        left, right = np.searchsorted(self.values, flat, "left"), np.searchsorted(self.values, flat, "right")
        ends = np.cumsum(right - left)  # of the places in the index that each shingle meets
        row = np.repeat(np.arange(len(sets)), sizes)
        both = np.zeros((len(sets), n), dtype=np.int64)
        a = 0
        while a < len(flat):  # similar documents meet in almost all shingles, so the places come in bounded parts
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PLACES, "right")))
            hits, top = right[a:b] - left[a:b], row[a]
            shift = left[a:b] - (np.cumsum(hits) - hits)
            place = np.arange(hits.sum()) + np.repeat(shift, hits)
            met = np.bincount(np.repeat((row[a:b] - top) * n, hits) + self.owner[place], minlength=(row[b - 1] - top + 1) * n)
            both[top : row[b - 1] + 1] += met.reshape(-1, n)
            a = b
        near = (both * 100 >= (sizes[:, None] + self.sizes[None, :] - both) * self.percent) & (both > 0) & (np.array(comps)[:, None] != self.comps[None, :])
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = self.find(int(comps[i])), self.find(int(self.comps[j]))
            if x != y:
                self.parent[x] = y
                out.append((self.docs[j], docs[i]))
        return out


def _against(batches: Iterator[pa.RecordBatch], config: NearConfig) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, side, doc, comp, shingles) sorted by the first three to links (a, b) between side 0 and side 1 of each key.

    Holds the index of one key's side 0 and a bounded slice of its side 1.
    """
    key: tuple[int, int] | None = None
    first: tuple[list, list, list] = ([], [], [])
    index: Index | None = None
    for batch in batches:
        k1, k2, side, docs, comps = (batch.column(i).to_pylist() for i in range(5))
        lists = batch.column(5)
        values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sets = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        found, i = [], 0
        while i < len(docs):
            if (k1[i], k2[i]) != key:
                key, first, index = (k1[i], k2[i]), ([], [], []), None
            if side[i] == 0:
                first[0].append(docs[i])
                first[1].append(comps[i])
                first[2].append(sets[i].copy())
                i += 1
                continue
            if index is None:
                index = Index(*first, config.percent) if first[0] else None
            j, work = i, 0
            while j < len(docs) and (k1[j], k2[j]) == key and (j == i or (work + len(sets[j]) * max(1, len(first[0]) // 8) < 2_000_000 and (j - i) * len(first[0]) < 2_000_000)):
                work += len(sets[j]) * max(1, len(first[0]) // 8)
                j += 1
            if index is not None:
                found += index.links(docs[i:j], comps[i:j], sets[i:j])
            i = j
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) to (doc, comp): the smallest id of each component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    docs = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([find(d) for d in docs], pa.int64())], names=["doc", "comp"])


def components(links: DataFrame, config: NearConfig, scratch: Scratch) -> DataFrame:
    """(doc, comp) for every document in ``links`` (a, b): the smallest id that it reaches.

    Few links are united in one task. More: large and small stars in turn until nothing changes; each
    step is two aggregations by key.
    """
    links = scratch.keep(links.select("a", "b").filter("a <> b"), "links")
    if links.count() <= config.last_links:
        comps = scratch.keep(links.repartition(1).mapInArrow(lean(_unions), "doc long, comp long"), "comps")
        scratch.drop(links)
        return comps
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    scratch.drop(links)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.keep(small, "small")
        scratch.drop(edges, large)
        edges = small
        now = tuple(small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        if now == state or now[0] == 0:
            break
        state = now
    comps = scratch.keep(edges.select(F.col("u").alias("doc"), F.col("v").alias("comp")), "comps")
    scratch.drop(edges)
    return comps


def postings(heads: DataFrame, config: NearConfig, scratch: Scratch) -> DataFrame:
    """(tok, doc, low): the coordinate values under which a document must be posted, with its signature's bytes.

    ``heads``: doc, sig. A pair that agrees in ``least`` coordinates agrees in some of the ``first`` ones
    (all but coordinates - least of them), so these alone leave the documents that can have a partner.
    """
    head = heads.select("doc", F.explode(F.slice("sig", 1, config.first)).alias("tok"))
    shared = lambda frame: frame.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    agree = head.join(shared(head).select("tok"), "tok", "left_semi").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    near = scratch.keep(agree.filter(F.col("n") >= config.first - (config.coordinates - config.least)).select("doc"), "near")
    open_ = scratch.keep(heads.join(near, "doc", "left_semi"), "open")
    every = open_.select("doc", F.explode("sig").alias("tok"))
    by = Window.partitionBy("doc")
    ranked = every.join(shared(every), "tok").withColumn("rank", F.row_number().over(by.orderBy("n", "tok"))).withColumn("all", F.count(F.lit(1)).over(by))
    prefix = ranked.filter(F.col("rank") <= F.col("all") - (config.least - 1)).select("tok", "doc")
    posts = scratch.keep(prefix.join(open_.mapInArrow(lean(_low), "doc long, low binary"), "doc").select("tok", "doc", "low"), "posts")
    scratch.drop(near, open_)
    return posts


def _verified(pairs: DataFrame, sets: DataFrame, config: NearConfig, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the pairs (lead, doc, lead_comp, comp) whose full sets are similar enough. A leader of many pairs is salted."""
    pairs = scratch.keep(pairs.distinct(), "pairs")
    salts = pairs.groupBy("lead", "lead_comp").agg(F.ceil(F.count(F.lit(1)) / config.reach).alias("salts"))
    dealt = pairs.join(salts.select("lead", "salts"), "lead").select(F.col("lead").alias("k1"), F.pmod(F.xxhash64("doc"), "salts").alias("k2"), F.lit(1).alias("side"), "doc", "comp")
    leads = salts.select(F.col("lead").alias("k1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("k2"), F.lit(0).alias("side"), F.col("lead").alias("doc"), F.col("lead_comp").alias("comp"))
    return _compared(leads.unionByName(dealt), sets, config)


def _compared(rows: DataFrame, sets: DataFrame, config: NearConfig) -> DataFrame:
    """Links of rows (k1, k2, side, doc, comp) between the two sides of each key."""
    full = rows.join(sets, "doc").select("k1", "k2", "side", "doc", "comp", "shingles")
    return full.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "side").mapInArrow(lean(lambda b: _against(b, config)), "a long, b long")


def _joined(labeled: DataFrame, config: NearConfig, scratch: Scratch) -> DataFrame:
    """Rows (tok, doc, comp, low, size, own) of long lists, with each set of connected lists made one where that takes fewer comparisons."""
    heads = labeled.groupBy("tok").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("n"))
    net = components(labeled.join(heads, "tok").select(F.col("doc").alias("a"), F.col("head").alias("b")), config, scratch)
    of_doc = labeled.select("doc").distinct().join(net.withColumnRenamed("comp", "net"), "doc", "left").select("doc", F.coalesce("net", "doc").alias("net"))
    of_doc = scratch.keep(of_doc, "nets")
    # a row a list, so that no task gets the documents of a net
    of_list = scratch.keep(heads.join(of_doc, F.col("head") == F.col("doc")).select("tok", "n", "net"), "lists")
    apart = of_list.groupBy("net").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    cheaper = of_doc.groupBy("net").agg(F.count(F.lit(1)).cast("double").alias("d")).join(apart, "net").filter("d * d <= apart").select("net", F.lit(True).alias("one"))
    named = labeled.join(of_list.select("tok", "net").join(cheaper, "net", "left"), "tok")
    tok = F.when(F.coalesce("one", F.lit(False)), F.xxhash64(F.lit("net"), "net")).otherwise(F.col("tok"))
    return scratch.keep(named.select(tok.alias("tok"), "doc", "comp", "low", "size", "own").distinct(), "joined")


def _in_blocks(labeled: DataFrame, sets: DataFrame, config: NearConfig) -> DataFrame:
    """Links of lists (tok, doc, comp, size): the documents outside a list's largest component, in blocks, against all its documents."""
    of_comp = labeled.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    lists = of_comp.groupBy("tok").agg(F.sum("n").alias("all"), F.sum("size").alias("all_size"), F.max(F.struct("n", "size", "comp")).alias("main"))
    blocks_ = F.greatest(F.ceil((F.col("all") - F.col("main.n")) / config.block), F.ceil((F.col("all_size") - F.col("main.size")) / config.block_shingles), F.lit(1))
    plan = lists.select("tok", F.col("main.comp").alias("main"), blocks_.cast("long").alias("nq"), F.ceil(F.col("all") / config.reach).cast("long").alias("nd"))
    met = labeled.select("tok", "doc", "comp").join(plan, "tok")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc", "tok"), F.col(n))
    name = lambda q, d: (q * F.lit(1 << 32) + d).alias("k2")
    ask = met.filter("comp <> main").select("*", upto("nd").alias("d")).select(F.col("tok").alias("k1"), name(own("nq"), F.col("d")), F.lit(0).alias("side"), "doc", "comp")
    all_ = met.select("*", upto("nq").alias("q")).select(F.col("tok").alias("k1"), name(F.col("q"), own("nd")), F.lit(1).alias("side"), "doc", "comp")
    return _compared(ask.unionByName(all_), sets, config)


def _bounds(labeled: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc, size, own): the shingles of each document of ``labeled``, and how many of them no other of these documents has."""
    left = sets.join(labeled.select("doc").distinct(), "doc", "left_semi")
    single = left.select("doc", F.explode("shingles").alias("x")).groupBy("x").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")).filter("doc = last")
    sizes = left.groupBy("doc").agg(F.max(F.size("shingles")).cast("long").alias("size"))
    return sizes.join(single.groupBy("doc").agg(F.count(F.lit(1)).alias("own")), "doc", "left").select("doc", "size", F.coalesce("own", F.lit(0)).alias("own"))


def near_links(heads: DataFrame, texts: DataFrame, config: NearConfig, scratch: Scratch) -> DataFrame:
    """(doc, comp) of the representatives (doc, sig) that are linked with others."""
    active = postings(heads, config, scratch)
    wanted = scratch.keep(active.select("doc").distinct(), "wanted")
    near = Bitmap(wanted.select(F.xxhash64("doc").alias("h")), scratch, 16)  # so that few texts are shuffled
    chosen = texts.filter(near.has(F.xxhash64("doc_id"))).join(wanted, texts["doc_id"] == wanted["doc"], "left_semi")
    sets = scratch.keep(chosen.mapInArrow(lean(lambda b: _sets(b, config)), "doc long, shingles array<long>"), "sets")
    scratch.drop(wanted, near.table)
    comps = heads.sparkSession.createDataFrame([], "doc long, comp long")
    last = len(config.leaders)
    for turn in range(last + 1):
        labeled = active.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        lists = labeled.groupBy("tok").agg(F.count(F.lit(1)).alias("many"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        labeled = scratch.keep(labeled.join(lists.select("tok", "many"), "tok"), "labeled")
        scratch.drop(active)
        if labeled.isEmpty():
            break
        if turn == min(1, last):
            bounds = scratch.keep(_bounds(labeled, sets).filter((F.col("size") - F.col("own")) * 100 >= F.col("size") * config.percent), "bounds")
            bounded = scratch.keep(labeled.join(bounds, "doc"), "bounded")
            scratch.drop(labeled, bounds)
            labeled = bounded
        links = comps.select(F.col("comp").alias("a"), F.col("doc").alias("b"))
        pairs, long, rest = None, labeled, None
        if turn:
            long = labeled.filter(F.col("many") > config.small)
            few = labeled.filter(F.col("many") <= config.small).select("tok", "doc", "comp", "low", "size", "own").repartition("tok").sortWithinPartitions("tok")
            pairs = few.mapInArrow(lean(lambda b: _paired(b, config)), "lead long, doc long, lead_comp long, comp long")
        if turn == min(1, last):
            long = _joined(long, config, scratch)
        if turn < last:
            known = [c for c in ("size", "own") if c in labeled.columns]
            of_comp = long.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("doc").alias("order"), "doc", "low", *known)).alias("lead"))
            place = F.row_number().over(Window.partitionBy("tok").orderBy("n", "lead.order", "lead.doc"))
            leaders = of_comp.withColumn("place", place).filter(F.col("place") <= config.leaders[turn])
            leaders = scratch.keep(leaders.select("tok", F.col("lead.doc").alias("lead"), F.col("lead.low").alias("lead_low"), F.col("comp").alias("lead_comp"), *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in known]), "leaders")
            met = long.join(leaders, "tok").filter("comp <> lead_comp")
            if known:
                most = F.least(F.col("size") - F.col("own"), F.col("lead_size") - F.col("lead_own"))
                met = met.filter(most * 100 >= (F.col("size") + F.col("lead_size") - most) * config.percent)
            met = met.select("lead", "doc", "lead_low", "low", "lead_comp", "comp").mapInArrow(lean(lambda b: _counted(b, config)), "lead long, doc long, lead_comp long, comp long")
            pairs = met if pairs is None else pairs.unionByName(met)
            rest = scratch.keep(long.join(leaders.select("tok", F.col("lead").alias("doc")), ["tok", "doc"], "left_anti").select("tok", "doc", "low", *known), "rest")
        else:
            links = links.unionByName(_in_blocks(long, sets, config))
        if pairs is not None:
            links = links.unionByName(_verified(pairs, sets, config, scratch))
        found = components(links, config, scratch)
        scratch.drop(labeled, comps)
        comps, active = found, rest
        if rest is None:
            break
    scratch.drop(sets)
    return comps


def near_duplicates(docs: DataFrame, config: NearConfig = NearConfig(), scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "near")
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = scratch.keep(texts.mapInArrow(lean(lambda b: _sketch(b, config)), "doc_id long, n_shingles long, k1 long, k2 long, sig array<long>"), "sketches")
    live = sketches.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.keep(live.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    heads = live.join(classes.withColumn("doc_id", F.col("rep")), ["doc_id", "k1", "k2", "n_shingles"], "left_semi").dropDuplicates(["doc_id", "k1", "k2", "n_shingles"]).select(F.col("doc_id").alias("doc"), "sig")
    linked = near_links(scratch.keep(heads, "heads"), texts, config, scratch)
    named = scratch.keep(classes.join(linked.withColumnRenamed("doc", "rep"), "rep", "left").select("k1", "k2", "n_shingles", F.coalesce("comp", "rep").alias("comp")), "named")
    scratch.drop(classes, linked)
    out = sketches.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, config: NearConfig = NearConfig(), scratch: Scratch | None = None) -> DataFrame:
    """One document of each group of near duplicates, with all its columns: that with the smallest id.

    Of rows that share an id, the one with the least text hash stays (and of these the one with the least
    hash of all columns).
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    ids = near_duplicates(docs, config, scratch).filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    special = scratch.keep(ids.filter("not kept or n > 1").select(F.col("doc_id").alias("_id"), (F.col("kept") & (F.col("n") > 1)).alias("_several")), "special")
    bitmap = Bitmap(special.select(F.xxhash64("_id").alias("h")), scratch, 16)
    scratch.drop_but(special, bitmap.table)
    hashed = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long")))
    out = without(docs, hashed, lambda gone: docs["doc_id"] == gone["_id"], special.select("_id"), bitmap)
    several = special.filter("_several")
    if several.isEmpty():
        return out
    # Maps have no hash; rows that differ in maps alone are taken as equal.
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.join(several, docs["doc_id"] == several["_id"], "left_semi")
    whole = rows.groupBy(F.col("doc_id").alias("_key")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.sha2("text", 256), F.xxhash64(*plain))).alias("_row"))
    return out.unionByName(whole.select("_row.*"))
