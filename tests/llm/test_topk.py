"""The threshold algorithm: ties, repeated ids, numbers beyond a long, and where it stops."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import topk


def plain(rows, asks, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if asks(q):
            score = lambda w: min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1)
            scores = sorted((-score(w), i) for i, w in usable if i != q and len(w) == len(v))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, k=5, **options):
    frame = spark.createDataFrame([(i, v, "extra", 1) for i, v in rows], "vec_id long, embedding array<double>, dims string, n int")
    return sorted(tuple(r) for r in topk.search(spark, frame, F.col("vec_id") % 50 == 0, k=k, **options).collect())


def test_ties_at_the_last_rank(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(301)]
    for blocks in ({}, {"block_rows": 16, "query_rows": 2}):
        assert found(spark, rows, **blocks) == plain(rows, lambda q: q % 50 == 0, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [2.0, -1.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("-inf"), 1.0])]
    rows += [(50, [0.001, 0.003]), (100, [3.0]), (150, [3.0, 4.0, 5.0]), (None, [9.0, 9.0]), (7, [-1.0, 0.0])]
    assert found(spark, rows) == plain(rows, lambda q: q % 50 == 0, 5)


def test_numbers_beyond_a_long(spark):
    rows = [(0, [1e9, 1.0]), (50, [1e17, -1e17]), (1, [3e12, 2.0]), (2, [1e20, 1e3]), (3, [-1e20, 5.0]), (4, [1e17, 1e17]), (5, [2.0, 2.0]), (6, [-3.0, 2.0])]
    assert found(spark, rows) == plain(rows, lambda q: q % 50 == 0, 5)


def test_search_stops_on_the_bound():
    """Where a few dimensions carry the scores, most entries are never read; results are the same."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(0, 1, (4096, 16)) * 0.5 ** np.arange(16))
    ids = np.arange(4096)
    block = topk.Block(ids, x, topk.sorted_lists(x))
    empty = np.empty(0, dtype=np.int64)
    depths = []
    for q in range(0, 4096, 64):
        scores, best, depth = block.search(x[q], q, 5, empty, empty)
        all_ = (x @ x[q]).astype(np.int64)
        order = [i for i in np.lexsort((ids, -all_)) if i != q][:5]
        assert best.tolist() == order and scores.tolist() == all_[order].tolist()
        depths.append(depth)
    assert np.mean(np.array(depths) < 4096) >= 0.9 and np.median(depths) <= 1024
    later, _, depth = block.search(x[0], 0, 5, np.full(5, 10**9), np.arange(5) + 10000)
    assert depth == 0 and later.tolist() == [10**9] * 5
