"""A query without direction."""

from __future__ import annotations

from ledgerline.llm import topk


def test_zero_query_gets_the_smallest_ids(spark):
    rows = [(i, [0.0, 0.003] if i == 7 else [float(i % 3 - 1), 0.5]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.search(spark, frame, frame["vec_id"] == 7, k=5).collect())
    assert got == [(7, rank + 1, i, 0) for rank, i in enumerate(range(5))]
