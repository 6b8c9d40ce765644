"""Rows that share an id, or have none, are mixed like any others."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from plain import WORD, mixing_targets


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: i // 20, lambda i: i], ids=["null", "repeated", "unique"])
def test_rows_of_any_id_meet_targets(spark, ids):
    docs = [(ids(i), " ".join([f"w{i}"] * (5 + i % 7)), f"src{i % 3}") for i in range(1200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    made = [tuple(r) for r in corpus_pipeline.mix_sources(spark, frame, "").collect()]
    by_source, taken = Counter(), Counter()
    for counter, rows in ((by_source, docs), (taken, made)):
        for r in rows:
            counter[r[2]] += len(WORD.findall(r[1]))
    assert set(made) <= set(docs)
    for source, target in mixing_targets(by_source).items():
        assert taken[source] == pytest.approx(target, rel=0.02)
