"""Bounded samples of labelled documents, and logistic calibration; shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, y): at most ``per_class`` documents of either label, those of lowest hash.

    The fold ``held_out`` of ``parts`` takes no part, nor do null labels.  The
    labels are cut to the bound first, so what is broadcast never grows.
    """
    usable = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).filter(
        (fold("__id", parts) != held_out) & F.col("y").isin(0, 1)
    )
    ranked = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for y in (0, 1)]
    chosen = ranked[0].union(ranked[1])
    return documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")


def fit_logistic(features: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method on standardised features; constant with one class."""
    x = np.asarray(features, dtype=float).reshape(len(y), -1 if len(y) else 1)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(y[0])
        return np.zeros(x.shape[1]), float(np.clip(share * 60 - 30, -30, 30))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-12
    z = np.c_[(x - mean) / scale, np.ones(len(y))]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 0.0]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z / len(y) + np.diag(penalty + 1e-9), z.T @ (p - y) / len(y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
