"""Toxic passages by maximum-scoring segments.

Training: log-odds of each feature between toxic and other texts, with an informative Dirichlet prior
(Monroe et al.), on a bounded sample of the labelled rows. Features are whole words and word beginnings,
so that unseen forms of a known stem count too. A word's score is that of the word, or else that of
its longest known beginning, or else a negative drift; sums of scores then have negative expectation in
clean text, and all maximal segments are found in one pass (Ruzzo and Tompa).

A segment's score is calibrated as an extreme value (Karlin and Altschul): the best of n words of clean
text exceeds x with probability 1 - exp(-constant * n * exp(-decay * x)). The decay solves
sum p * exp(decay * score) = 1 over the word scores of clean texts, as they are scored (features never
seen there count half a time, so the root is finite); the constant is the likeliest for the best
segments of clean texts that had no part in the odds. A text's statistic is the sum of the normalised
scores of its significant segments less the logarithm of constant * n. It is made a probability by
logistic regression on the rows that had no part in the odds.

Defined cases: null and empty texts have no segment and get the score of the least statistic; labels
that are null or whose document is missing are not used; of rows that share an id the text that sorts
first is learnt from, with the greater label; without labels of both kinds all texts get the share of
toxic ones among the labels (0 without any); repeated rows are scored alike; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship_by_value

ship_by_value(__name__)


@dataclass(frozen=True)
class ToxicConfig:
    #: Bounds: labelled rows to learn from (those of the least hashes), words of the model.
    sample: int = 20_000
    vocabulary: int = 20_000
    #: Lengths of word beginnings that are features.
    stems: tuple[int, ...] = (4, 5, 6, 7, 8)
    prior: float = 20_000.0
    #: Least z-score and texts of a feature.
    least_z: float = 3.0
    least_docs: int = 5
    #: Least share of toxic texts among the texts with a feature.
    least_share: float = 0.5
    #: One in so many of the sample is kept from the odds, for the calibration.
    apart: int = 4
    #: Segments with more expected chance hits than this in a text aren't significant.
    chance: float = 1.0


@dataclass
class Model:
    """Scores of words and beginnings, what any other word costs, and the calibration."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    sizes: tuple[int, ...] = ()
    drift: float = -0.1
    decay: float = 1.0
    constant: float = 1.0
    slope: float = 0.0
    intercept: float = -20.0
    chance: float = 1.0

    def score(self, word: str) -> float:
        got = self.words.get(word)
        if got is None:
            for n in self.sizes:
                if len(word) > n and (got := self.stems.get(word[:n])) is not None:
                    return got
            return self.drift
        return got


_EDGES = dict.fromkeys(map(ord, ".,;:!?\"'()[]{}#*$%&|<>-_"), " ")


def text_words(text: str) -> list[str]:
    return text.lower().translate(_EDGES).split()


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), by Ruzzo and Tompa's stack.

    ``hits``: places and scores of the words that don't have the drift, in order.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total, at = 0.0, -1
    for place, value in hits:
        total += drift * (place - at - 1)
        at = place
        before, total = total, total + value
        if value <= 0:
            continue
        first, left = place, before
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= total:
                break
            first, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, place, left, total))
    return [(a, b, after - before) for a, b, before, after in stack]


def statistic(words: list[str], model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """The text's statistic and its significant segments with their normalised scores."""
    score, drift = model.score, model.drift
    known: dict[str, float] = {}
    hits = []
    for i, w in enumerate(words):
        s = known.get(w)
        if s is None:
            s = known[w] = score(w)
        if s != drift:
            hits.append((i, s))
    if not hits:
        return 0.0, []
    size = math.log(max(model.constant * len(words), 1e-300))
    normal = [(a, b, model.decay * s) for a, b, s in segments(hits, drift)]
    found = [(a, b, s - size) for a, b, s in normal if s - size > -math.log(model.chance)]
    return sum(s for _, _, s in found), found


def _decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum weight * exp(decay * score) = 1, for a negative mean and some positive score of positive weight; 1 where there is none."""
    p, most = weights / weights.sum(), scores.argmax() if len(scores) else 0
    if not len(scores) or (p * scores).sum() >= 0 or scores[most] <= 0 or p[most] <= 0:
        return 1.0
    low, high = 0.0, -math.log(p[most]) / scores[most]  # here the greatest score alone gives 1
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return high


def _constant(best: np.ndarray, words: np.ndarray, least: float) -> float:
    """The likeliest constant for the best normalised scores of clean texts of so many words; 0 means a score below ``least``."""
    spread = (words * np.exp(-np.maximum(best, least))).sum()
    return float(max((best > 0).sum(), 0.5) / spread) if spread > 0 else 1.0


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and intercept, by Newton's method with a small ridge."""
    a, b = 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([((y - p) * x).sum() - 1e-3 * a, (y - p).sum()])
        hessian = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def _words_of(batches: Iterator[pa.RecordBatch], config: ToxicConfig) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (feature, toxic, n, docs), summed within each batch; features: w:word, p:beginning."""
    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: dict[str, int] = {}
            for w in text_words(text or ""):
                own["w:" + w] = own.get("w:" + w, 0) + 1
                for n in config.stems:
                    if len(w) > n:
                        own["p:" + w[:n]] = own.get("p:" + w[:n], 0) + 1
            for f, n in own.items():
                got = sums.setdefault((f, toxic), [0, 0])
                got[0] += n
                got[1] += 1
        keys = list(sums)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "n", "docs"])


def _seen(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(text) to (score, n): how often words have which score; null for the drift."""
    for batch in batches:
        counts: dict[float | None, int] = {}
        for text in batch.column(0).to_pylist():
            for w in text_words(text or ""):
                got = model.score(w)
                got = None if got == model.drift else got
                counts[got] = counts.get(got, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], names=["score", "n"])


def _best(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (best normalised segment or 0, words, toxic)."""
    for batch in batches:
        best, sizes = [], []
        for text in batch.column(0).to_pylist():
            words = text_words(text or "")
            hits = [(i, s) for i, s in enumerate(map(model.score, words)) if s != model.drift]
            best.append(model.decay * max((s for _, _, s in segments(hits, model.drift)), default=0.0))
            sizes.append(len(words))
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(sizes, pa.int64()), batch.column(1)], names=["best", "words", "toxic"])


def _statistics(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistic(text_words(t or ""), model)[0] for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], names=["x", "toxic"])


def odds(texts: DataFrame, config: ToxicConfig, scratch: Scratch) -> DataFrame:
    """(feature, odds) of the features that tell toxic texts (text, toxic) from others; the most certain, config.vocabulary at most."""
    counted = texts.mapInArrow(lambda b: _words_of(b, config), "feature string, toxic int, n long, docs long")
    by = lambda c, t: F.sum(F.when(F.col("toxic") == t, F.col(c)).otherwise(0))
    counts = scratch.keep(counted.groupBy("feature").agg(by("n", 1).alias("y1"), by("n", 0).alias("y0"), by("docs", 1).alias("d1"), by("docs", 0).alias("d0")), "counts")
    word = counts.filter(F.col("feature").startswith("w:")).agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0")).first()
    n1, n0 = float(word["n1"] or 0) or 1.0, float(word["n0"] or 0) or 1.0
    alpha = (F.col("y1") + F.col("y0")) / F.lit(n1 + n0) * config.prior + 0.01
    side = lambda y, n: F.log((F.col(y) + alpha) / (F.lit(n + config.prior) - F.col(y) - alpha))
    ratio = (side("y1", n1) - side("y0", n0)).alias("odds")
    z = ratio / F.sqrt(1 / (F.col("y1") + alpha) + 1 / (F.col("y0") + alpha))
    share = F.col("d1") / (F.col("d1") + F.col("d0"))
    good = counts.select("feature", "d1", ratio, z.alias("z"), share.alias("share")).filter((F.col("z") >= config.least_z) & (F.col("d1") >= config.least_docs) & (F.col("share") >= config.least_share) & (F.col("odds") > 0))
    return good.orderBy(F.desc("z"), "feature").limit(config.vocabulary).select("feature", "odds")


def train(docs: DataFrame, labels: DataFrame, usable: Column, config: ToxicConfig = ToxicConfig(), scratch: Scratch | None = None) -> Model:
    """A model from the ``labels`` (doc_id, toxic) whose doc_id is ``usable``, config.sample rows at most."""
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    # At most config.sample rows of 12 bytes: small enough to send everywhere, whatever the corpus.
    chosen = labels.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample)
    known = scratch.keep(chosen, "chosen")
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    texts = scratch.keep(texts.select("text", "toxic", (F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(config.apart)) == 0).alias("apart")), "texts")
    totals = {(r["toxic"], r["apart"]): r["n"] for r in texts.groupBy("toxic", "apart").agg(F.count(F.lit(1)).alias("n")).collect()}
    has = lambda apart: all(totals.get((t, apart)) for t in (0, 1))
    model = Model(sizes=tuple(sorted(config.stems, reverse=True)), chance=config.chance)
    if not (totals.get((0, False)) or totals.get((0, True))) or not (totals.get((1, False)) or totals.get((1, True))):
        model.intercept = 20.0 if any(t == 1 for t, _ in totals) else -20.0
        return model
    split = has(True) and has(False)  # a handful of labels serves for both
    learn, fit = (texts.filter("not apart"), texts.filter("apart")) if split else (texts, texts)
    for r in odds(learn.select("text", "toxic"), config, scratch).collect():
        (model.words if r["feature"][0] == "w" else model.stems)[r["feature"][2:]] = float(r["odds"])
    # Clean text: most words cost the drift, known ones come up by chance.
    model.drift = 0.0
    seen = learn.filter("toxic = 0").select("text").mapInArrow(lambda b: _seen(b, model), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    times = dict.fromkeys([*model.words.values(), *model.stems.values()], 0.5) | {r["score"]: float(r["n"]) for r in seen if r["score"] is not None}
    scores, weights = np.array(list(times)), np.array(list(times.values()))
    rest = max(1.0, float(sum(r["n"] for r in seen if r["score"] is None)))
    model.drift = -max(0.05, 4 * float((scores * weights).sum() / (weights.sum() + rest)))
    model.decay = _decay(np.append(scores, model.drift), np.append(weights, rest))
    # Bounded: one row for each of the sample's texts.
    best = fit.filter("toxic = 0").select("text", "toxic").mapInArrow(lambda b: _best(b, model), "best double, words long, toxic int").toPandas()
    model.constant = _constant(best["best"].to_numpy(), best["words"].to_numpy(dtype=float), model.decay * float(scores.min(initial=1.0)))
    fitted = fit.select("text", "toxic").mapInArrow(lambda b: _statistics(b, model), "x double, toxic int").toPandas()
    model.slope, model.intercept = _logistic(fitted["x"].to_numpy(), fitted["toxic"].to_numpy(dtype=float))
    scratch.close()
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score, count, passages = [], [], []
        for t in batch.column(1).to_pylist():
            x, found = statistic(text_words(t or ""), model)
            score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.intercept)))))
            count.append(len(found))
            passages.append(",".join(f"{a}:{b + 1}:{s:.3f}" for a, b, s in found))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(passages, pa.string())], names=["doc_id", "score", "n_segments", "segments"])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_segments and segments (first word:end:normalised score) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _score(b, model), "doc_id long, score double, n_segments long, segments string")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def toxicity_digest(docs: DataFrame, labels: DataFrame, config: ToxicConfig = ToxicConfig()) -> DataFrame:
    model = train(docs, labels, ~held_out(), config)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_segments", "segments")
