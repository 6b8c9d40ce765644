"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words in lower case and their stems, the beginnings of ``shortest`` to
``longest`` characters, so that inflected and derived forms share their
evidence; a word scores as itself or else as its longest stem with a score.  A stem's score is its
log-odds between toxic and clean labelled documents under an informative
Dirichlet prior, shrunk to zero unless it is significant, less a drift that
makes clean text fall.  A linear scan finds every maximal-scoring segment of a
text; the maximum over a clean text of n tokens follows the extreme-value law
P(S >= x) = 1 - exp(-K n exp(-lambda x)), with lambda from the score distribution of
clean tokens and K by maximum likelihood from clean documents.  Segments whose
tail probability is at most ``alpha`` are the toxic passages; their excess bits
over ln(K n), added up, are calibrated to a probability.

Sample bound: ``per_class`` documents of each label, near copies thinned to one
by a shingle sketch.  All significant tokens of the sample are in the model.

Defined results: a null or empty text has no segment and scores what calibration
gives to none; with labels of one class only every text gets that class.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.llm.labelled import fit_logistic, fold, labelled_sample, sigmoid
from ledgerline.sources.scratch import Scratch


@dataclass
class Model:
    """Token scores and the two calibrations."""

    shortest: int
    longest: int
    scores: dict[str, float]
    drift: float
    lam: float = 1.0
    k: float = 1.0
    alpha: float = 0.01
    weight: float = 0.0
    intercept: float = -30.0

    def __post_init__(self) -> None:
        self.heads = {t[: self.shortest] for t in self.scores}

    def word(self, word: str) -> float | None:
        """Score of the longest stem that has one; most words are settled by their first characters."""
        if word[: self.shortest] not in self.heads:
            return None
        if len(word) > self.longest and (score := self.scores.get(word)) is not None:
            return score
        for n in range(min(len(word), self.longest), self.shortest - 1, -1):
            if (score := self.scores.get(word[:n])) is not None:
                return score
        return self.scores.get(word) if len(word) < self.shortest else None


def stems(words: list[str], shortest: int, longest: int) -> set[str]:
    """Some words and every stem of theirs."""
    found = set(words)
    return found | {w[:n] for w in found for n in range(shortest, min(len(w), longest) + 1)}


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence, in linear time.

    ``scores`` are those of the tokens at ``places``, drift included; every
    other token scores -drift.  Each segment carries the cumulative score before
    it and at its end.  A positive token opens one; it merges with the latest
    segment that starts lower, if that one also ends lower, and then again.
    """
    found: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # of each segment, the latest one before it that starts lower
    total, at = 0.0, 0
    for place, score in zip(places, scores):
        total -= drift * (place - at)
        at = place + 1
        if score <= 0:
            total += score
            continue
        first, before = place, total
        total += score
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= before:
                k = lower[k]
            if k < 0 or found[k][3] >= total:
                break
            first, before = found[k][0], found[k][2]
            del found[k:], lower[k:]
        found.append((first, place, before, total))
        lower.append(k)
    return [(first, last, end - before) for first, last, before, end in found]


def evidence(text: str | None, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens and maximal segments of a text."""
    words = text.lower().split() if text else []
    heads, n = model.heads, model.shortest
    hits = [(i, s) for i, w in enumerate(words) if w[:n] in heads and (s := model.word(w)) is not None]
    return len(words), maximal_segments([i for i, _ in hits], [s - model.drift for _, s in hits], model.drift)


def tail(score: float, n: int, model: Model) -> float:
    """Probability that a clean text of n tokens has a segment of this score or more."""
    return -math.expm1(-model.k * max(n, 1) * math.exp(-model.lam * score))


def passages(text: str | None, model: Model) -> list[tuple[int, int, float, float]]:
    """Significant segments of a text: first and last token, score, tail probability."""
    n, segments = evidence(text, model)
    return [(a, b, s, p) for a, b, s in segments if (p := tail(s, n, model)) <= model.alpha]


def excess(text: str | None, model: Model) -> float:
    """Logarithm of the summed excess of the significant segments over chance."""
    n, segments = evidence(text, model)
    chance = math.log(model.k * max(n, 1))
    return math.log1p(sum(max(0.0, model.lam * s - chance) for _, _, s in segments if tail(s, n, model) <= model.alpha))


def _sketch(words: list[str]) -> int:
    """Smallest shingle hash: near copies mostly agree, other texts never do."""
    from xxhash import xxh3_64_intdigest

    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    return min(xxh3_64_intdigest(g) for g in grams) - (1 << 63)


def log_odds(toxic: int, clean: int, prior: float) -> tuple[Column, Column]:
    """(log-odds, standard error) of a token in ``a`` toxic and ``b`` clean documents of so many."""
    background = F.lit(prior) * (F.col("a") + F.col("b")) / (toxic + clean)
    odds = lambda n, of: (n + background) / (of + prior - n - background)
    delta = F.log(odds(F.col("a"), toxic) / odds(F.col("b"), clean))
    return delta, F.sqrt(1 / (F.col("a") + background) + 1 / (F.col("b") + background))


def _positive_root(values: np.ndarray, weights: np.ndarray) -> float:
    """The lambda > 0 with sum(weights * exp(lambda * values)) = 1, for a negative mean."""
    low, high = 0.0, 1.0
    value = lambda x: float(np.sum(weights * np.exp(np.minimum(x * values, 700.0))))
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return high


def train(
    spark: SparkSession,
    documents: DataFrame,
    labels: DataFrame,
    parts: int = 3,
    held_out: int = 1,
    per_class: int = 3000,
    shortest: int = 3,
    longest: int = 12,
    significant: float = 3.0,
    prior: float = 100.0,
    alpha: float = 0.01,
) -> Model:
    scratch = Scratch(spark, "toxicity")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_sketch((t.as_py() or "").lower().split()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64())], names=["doc_id", "text", "y", "sketch"])

    drawn = labelled_sample(documents, labels, "toxic", parts, held_out, per_class).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y")
    drawn = scratch.save(drawn.mapInArrow(sketch, "doc_id long, text string, y int, sketch long"), "drawn")
    leads = drawn.groupBy("y", "sketch").agg(F.min("doc_id").alias("doc_id")).select(F.col("doc_id").alias("__lead"))
    sample = scratch.save(drawn.join(leads, F.col("doc_id") == F.col("__lead"), "left_semi").select("text", "y"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                found[y].update(stems((t.as_py() or "").lower().split(), shortest, longest))
            tokens = sorted(found[0] | found[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.string()), *[pa.array([found[y][w] for w in tokens], pa.int64()) for y in (1, 0)]], names=["token", "a", "b"]
            )

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(shortest, longest, {}, 0.5, intercept=30.0 if toxic else -30.0 if clean else 0.0)
    counts = sample.mapInArrow(count, "token string, a long, b long").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    delta, error = log_odds(toxic, clean, prior)
    scored = counts.select("token", delta.alias("delta"), error.alias("error")).filter(F.abs("delta") >= significant * F.col("error"))
    scores = dict(sorted((r["token"], r["delta"]) for r in scored.collect()))
    model = Model(shortest, longest, scores, 0.0, alpha=alpha)

    # how often clean text shows each score
    shared = spark.sparkContext.broadcast(model)

    def spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(0):
                seen.update(round(m.word(w) or 0.0, 1) for w in (t.as_py() or "").lower().split())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["s", "n"])

    rows = sample.filter("y = 0").select("text").mapInArrow(spectrum, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    # one more of each score that the model can give, so that none is impossible
    seen = Counter({r["s"]: r["n"] for r in rows})
    seen.update({round(s, 1) for s in scores.values()} | {0.0})
    values = np.array(sorted(seen))
    weights = np.array([seen[v] for v in sorted(seen)], dtype=float)
    weights /= weights.sum()
    model.drift = float(max(0.5, values @ weights + 0.5))
    model.lam = _positive_root(values - model.drift, weights)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(t.as_py(), model) for t in batch.column(0)]
            best = [max((s for _, _, s in segments), default=0.0) for _, segments in found]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(best, pa.float64())], names=["n", "s"])

    clean_tops = sample.filter("y = 0").select("text").mapInArrow(tops, "n long, s double").collect()
    model.k = len(clean_tops) / sum(max(r["n"], 1) * math.exp(-model.lam * r["s"]) for r in sorted(clean_tops))

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([excess(t.as_py(), model) for t in batch.column(0)], pa.float64())], names=["y", "x"])

    pairs = sorted(sample.mapInArrow(calibrate, "y int, x double").collect(), key=lambda r: (r["y"], r["x"]))
    found, model.intercept = fit_logistic(np.array([r["x"] for r in pairs]), np.array([r["y"] for r in pairs]), ridge=1e-3)
    model.weight = float(found[0])
    return model


def score(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages): probability of label 1, and the significant passages by token numbers."""
    shared = spark.sparkContext.broadcast(model)
    item = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("tail", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            marks, spans = [], []
            for t in batch.column(1):
                n, segments = evidence(t.as_py(), m)
                kept = [(a, b, s, p) for a, b, s in segments if (p := tail(s, n, m)) <= m.alpha]
                chance = math.log(m.k * max(n, 1))
                marks.append(math.log1p(sum(max(0.0, m.lam * s - chance) for _, _, s, _ in kept)))
                spans.append([dict(zip(("first", "last", "score", "tail"), x)) for x in kept])
            scores = sigmoid(np.array(marks) * m.weight + m.intercept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(item))], names=["doc_id", "score", "passages"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double, passages array<struct<first:int,last:int,score:double,tail:double>>")


def score_column(spark: SparkSession, model: Model):
    """The score as a function of a text column, for filters that keep all other columns."""
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for part in parts:
            yield pd.Series(sigmoid(np.array([excess(t, m) for t in part], dtype=float) * m.weight + m.intercept), dtype=float)

    return F.pandas_udf(run, "double")


def classify(spark: SparkSession, documents: DataFrame, labels: DataFrame, threshold: float = 0.7, parts: int = 3, held_out: int = 1, **training) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every document."""
    model = train(spark, documents, labels, parts, held_out, **training)
    return score(spark, documents, model).select(
        "doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages"
    )
