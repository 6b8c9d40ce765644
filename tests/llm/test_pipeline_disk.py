"""What the stages of the pipeline leave on disk."""

from __future__ import annotations

import os

import corpus_pipeline
from ledgerline.sources.scratch import shared_root


def test_search_for_near_copies_leaves_no_tables(spark):
    root = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, "quite another text of a few words"), (None, text)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    made = sorted(name.split("-")[0] for name in set(os.listdir(root)) - before)
    assert made == ["dropped"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, text), (1, text), (4, "quite another text of a few words")]
