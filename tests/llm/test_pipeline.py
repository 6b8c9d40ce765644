"""Each pipeline stage against a plain version of it, on all that its predecessor kept, over whole tables."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerline.llm import quality, toxicity
from ledgerline.sources.scratch import Scratch
from plain import WORD, mixing_targets, top_segments
from test_shingles import kept_ids


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Input and output table of every stage."""
    scratch = Scratch(spark, "steps")
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = scratch.save(stage(spark, docs, sf), name)
        found[name] = (docs, made)
        docs = made
    return found


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def rows(frame) -> Counter:
    return Counter(tuple(r) for r in frame.collect())


def kept_by(frame, keep) -> Counter:
    return Counter(tuple(r) for r in frame.collect() if keep(r))


def test_quality_stage(spark, steps, labels):
    import zstandard

    docs, made = steps["quality"]
    model = quality.train(spark, docs, labels)
    options = {"level": model.level, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
    books = [zstandard.ZstdCompressionDict(content) for content in (model.good, model.bad)]

    def keep(r) -> bool:
        raw = (r.text or "").encode()
        x = 0.0
        if raw:
            parts = [raw[a : a + model.block] for a in range(0, len(raw), model.block)]
            good, bad = (sum(len(zstandard.ZstdCompressor(dict_data=book, **options).compress(p)) for p in parts) for book in books)
            x = (good - bad) / len(raw)
        return 1 / (1 + math.exp(-(x * model.weight + model.intercept))) >= 0.3

    assert rows(made) == kept_by(docs, keep)
    assert 0 < made.count() < docs.count()


def test_toxicity_stage(spark, steps, labels):
    docs, made = steps["toxicity"]
    model = toxicity.train(spark, docs, labels)

    def keep(r) -> bool:
        words = (r.text or "").lower().split()
        n = max(len(words), 1)
        chance = math.log(model.k * n)
        total = 0.0
        for _, _, s in top_segments([(model.word(w) or 0.0) - model.drift for w in words]):
            if 1 - math.exp(-model.k * n * math.exp(-model.lam * s)) <= model.alpha:
                total += max(0.0, model.lam * s - chance)
        return 1 / (1 + math.exp(-(math.log1p(total) * model.weight + model.intercept))) < 0.7

    assert rows(made) == kept_by(docs, keep)
    assert 0 < made.count() < docs.count()


def test_near_copies_stage(steps):
    docs, made = steps["near_copies"]
    lead = kept_ids([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(made) == kept_by(docs, lambda r: r.doc_id in lead)
    assert made.count() < docs.count()


def test_mixing_stage(steps):
    docs, made = steps["mixing"]
    size = lambda r: len(WORD.findall(r.text or ""))
    by_source, taken = Counter(), Counter()
    for r in docs.collect():
        by_source[r.source] += size(r)
    for r in made.collect():
        taken[r.source] += size(r)
    before, after = rows(docs), rows(made)
    assert set(after) <= set(before) and max(after.values()) <= 3
    for source, target in mixing_targets(by_source).items():
        assert taken[source] == pytest.approx(target, rel=0.02)


def test_sentencepiece_stage_and_run(spark, sf, steps):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, made = steps["sentencepiece"]
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want[r.doc_id, len(ids), tuple(ids), library.decode(ids) == (r.text or "")] += 1
    as_rows = lambda frame: Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.round_trip) for r in frame.collect())
    assert as_rows(made) == want
    assert as_rows(corpus_pipeline.run(spark, sf)) == want


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_repeated_search(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 60))
    scores = rng.normal(0.0, 2.0, n) * (rng.random(n) < 0.6)
    drift = float(rng.uniform(0.1, 1.0))
    at = np.flatnonzero(scores)
    got = toxicity.maximal_segments(at.tolist(), (scores[at] - drift).tolist(), drift)
    want = sorted(top_segments(scores - drift))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])
