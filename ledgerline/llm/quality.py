"""Quality classifier by compression: which dictionary makes a text smaller.

Two zstandard dictionaries are built, one from good and one from bad labelled
text.  A text is compressed with both in blocks of ``block`` bytes, so that its
end counts like its beginning, and the sizes are summed over the whole text.
The difference (good - bad), normalised by the length of the text, is the
evidence, and nothing else; it is calibrated to a probability of label 1 by
logistic regression on labelled documents that built no dictionary.

Sample bound: ``per_class`` documents of each label; three quarters build the
dictionaries, of ``dictionary`` bytes each, from at most ``blocks_per_document``
blocks of each document, one quarter calibrates.  Where the blocks are too few to train
a dictionary from, they are one themselves, as raw content.

Defined results: a null or empty text has no evidence and scores what
calibration gives to none; with labels of one class only every text gets that
class, without labels 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.labelled import fit_logistic, fold, labelled_sample, sigmoid
from ledgerline.sources.scratch import Scratch


@dataclass
class Model:
    """Two dictionaries and a calibration; a few hundred kilobytes whatever the corpus."""

    good: bytes
    bad: bytes
    level: int
    block: int
    weight: float = 0.0
    intercept: float = 0.0


class Scorer:
    """Compressors of a model; made once per Python worker."""

    def __init__(self, model: Model) -> None:
        import zstandard

        self.model = model
        options = {"level": model.level, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
        self.compressors = []
        for content in (model.good, model.bad):
            trained = zstandard.ZstdCompressionDict(content)
            trained.precompute_compress(level=model.level)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=trained, **options))

    def evidence(self, text: str | None) -> float:
        """Normalised size difference."""
        raw = text.encode() if text else b""
        if not raw:
            return 0.0
        good = bad = 0
        for a in range(0, len(raw), self.model.block):
            part = raw[a : a + self.model.block]
            good += len(self.compressors[0].compress(part))
            bad += len(self.compressors[1].compress(part))
        return (good - bad) / len(raw)


def _blocks(text: str | None, size: int, most: int) -> list[bytes]:
    """Up to ``most`` blocks spread over a whole text."""
    raw = text.encode() if text else b""
    parts = [raw[a : a + size] for a in range(0, len(raw), size)]
    return [parts[k * len(parts) // most] for k in range(most)] if len(parts) > most else parts


def train(
    spark: SparkSession,
    documents: DataFrame,
    labels: DataFrame,
    parts: int = 5,
    held_out: int = 0,
    per_class: int = 3000,
    blocks_per_document: int = 8,
    block: int = 1024,
    dictionary: int = 1 << 16,
    level: int = 3,
) -> Model:
    import zstandard

    scratch = Scratch(spark, "quality")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    sample = scratch.save(labelled_sample(documents, labels, "quality", parts, held_out, per_class).withColumn("calibrates", calibrates), "sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(y, b) for t, y in zip(batch.column(0), batch.column(1).to_pylist()) for b in _blocks(t.as_py(), block, blocks_per_document)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["y", "b"])

    pieces = sample.filter("not calibrates").select("text", "y").mapInArrow(cut, "y int, b binary").select("y", "b", F.xxhash64("b").alias("h")).collect()
    built = []
    for y in (1, 0):  # the bounded sample is put in an order that no partition decides
        own = sorted((r["h"], bytes(r["b"])) for r in pieces if r["y"] == y and len(r["b"]) >= 16)
        built.append(_dictionary([b for _, b in own], dictionary, level))
    model = Model(built[0], built[1], level, block)

    shared = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.evidence(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.float64())], names=["y", "x"])

    rows = sorted(tuple(r) for r in sample.filter("calibrates").select("text", "y").mapInArrow(weigh, "y int, x double").collect())
    weights, model.intercept = fit_logistic(np.array([x for _, x in rows]), np.array([y for y, _ in rows]))
    model.weight = float(weights[0])
    return model


def _dictionary(samples: list[bytes], size: int, level: int) -> bytes:
    """A trained dictionary, or the raw samples where they are too few to train from."""
    import zstandard

    if sum(map(len, samples)) >= 4 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=200, d=8, level=level).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size] or b"\0" * 8


def score(spark: SparkSession, documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): probability of label 1 for every whole text."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = np.array([scorer.evidence(t.as_py()) for t in batch.column(1)], dtype=float)
            scores = sigmoid(found * scorer.model.weight + scorer.model.intercept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double")


def score_column(spark: SparkSession, model: Model):
    """The score as a function of a text column, for filters that keep all other columns."""
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for part in parts:
            found = np.array([scorer.evidence(t) for t in part], dtype=float)
            yield pd.Series(sigmoid(found * scorer.model.weight + scorer.model.intercept), dtype=float)

    return F.pandas_udf(run, "double")


def classify(spark: SparkSession, documents: DataFrame, labels: DataFrame, threshold: float = 0.3, parts: int = 5, held_out: int = 0, **training) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(spark, documents, labels, parts, held_out, **training)
    return score(spark, documents, model).select(
        "doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
