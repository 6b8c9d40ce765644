"""Near copies of the pipeline against brute-force Jaccard over five-word shingles."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from plain import WORD, lower, smallest_reachable


def shingle_set(text: str | None) -> set:
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_ids(docs: list) -> set:
    """Smallest ids of the groups of pairs with Jaccard 0.8 or more."""
    ids = sorted({d for d, _ in docs})
    at = {d: i for i, d in enumerate(ids)}
    sets = [(at[d], shingle_set(t)) for d, t in docs]
    pairs = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if 5 * common >= 4 * (len(x) + len(y) - common):
                pairs.append((a, b))
    roots = smallest_reachable(len(ids), pairs)
    return {d for d in ids if roots[at[d]] == at[d]}


def stage_ids(spark, docs: list) -> set:
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()}


def test_similar_texts_are_near_copies(spark):
    rng = np.random.default_rng(7)
    book = [f"w{i}" for i in range(3000)]
    docs, passage = [], rng.choice(book, 40).tolist()
    for base in range(60):
        n = int(rng.choice([3, 30, 100, 200, 400]))
        words = rng.choice(book, n).tolist() + (passage if base % 3 == 0 else [])
        for copy in range(6):
            changed = list(words)
            for k in rng.choice(len(words), min(len(words) - 1, copy * len(words) // 60), replace=False):
                changed[k] = str(rng.choice(book))
            docs.append((len(docs) * 7 % 361, " ".join(changed)))
    docs += [(900, None), (901, ""), (902, " \t "), (903, docs[0][1]), (903, "another text of the same id"), (904, "another text OF the same id")]
    want = kept_ids(docs)
    assert 60 < len(want) < 300
    assert stage_ids(spark, docs) == want


def test_real_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert stage_ids(spark, docs) == kept_ids(docs)
