"""Training of the classifiers, and the mix's copies, against plain versions over whole tables."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import mixing, quality, toxicity
from ledgerline.llm.labelled import labelled_sample
from plain import WORD, mixing_targets, top_segments


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def logistic(x: list[float], y: list[int], ridge: float) -> tuple[float, float]:
    """Weight and intercept by small steps downhill on the standardised feature."""
    x, y = np.array(x), np.array(y, dtype=float)
    mean, scale = x.mean(), x.std() + 1e-12
    z, w, b = (x - mean) / scale, 0.0, 0.0
    for _ in range(200_000):
        p = 1 / (1 + np.exp(-(w * z + b)))
        dw, db = ((p - y) * z).mean() + ridge * w, (p - y).mean()
        w, b = w - 2 * dw, b - 2 * db
        if abs(dw) + abs(db) < 1e-9:
            break
    return w / scale, b - w * mean / scale


def test_quality_training(spark, tables):
    import zstandard

    docs, labels = tables
    model = quality.train(spark, docs, labels)
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    sample = labelled_sample(docs, labels, "quality", 5, 0, 3000).withColumn("calibrates", calibrates).collect()
    blocks = []
    for r in sample:
        raw = (r.text or "").encode()
        parts = [raw[a : a + 1024] for a in range(0, len(raw), 1024)]
        if not r.calibrates:
            spread = [parts[k * len(parts) // 8] for k in range(8)] if len(parts) > 8 else parts
            blocks += [(r.y, bytes(p)) for p in spread if len(p) >= 16]
    hashed = spark.createDataFrame(blocks, "y int, b binary").select("y", "b", F.xxhash64("b").alias("h")).collect()
    for y, made in ((1, model.good), (0, model.bad)):
        own = [bytes(r.b) for r in sorted((r for r in hashed if r.y == y), key=lambda r: (r.h, bytes(r.b)))]
        whole = sum(map(len, own)) >= 4 << 16
        want = zstandard.train_dictionary(1 << 16, own, k=200, d=8, level=3).as_bytes() if whole else b"".join(own)[: 1 << 16]
        assert made == want
    options = {"level": 3, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
    books = [zstandard.ZstdCompressionDict(b) for b in (model.good, model.bad)]
    x, y = [], []
    for r in sample:
        if r.calibrates:
            raw = (r.text or "").encode()
            good, bad = (sum(len(zstandard.ZstdCompressor(dict_data=b, **options).compress(raw[a : a + 1024])) for a in range(0, len(raw), 1024)) for b in books)
            x.append((good - bad) / len(raw) if raw else 0.0)
            y.append(r.y)
    assert (model.weight, model.intercept) == pytest.approx(logistic(x, y, 1e-4), rel=1e-3)


def test_toxicity_training(spark, tables):
    import xxhash

    docs, labels = tables
    model = toxicity.train(spark, docs, labels)
    drawn = [(r.doc_id, (r.text or "").lower().split(), r.y) for r in labelled_sample(docs, labels, "toxic", 3, 1, 3000).collect()]
    first: dict = {}
    for d, words, y in sorted(drawn):
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        first.setdefault((y, min(xxhash.xxh3_64_intdigest(g) for g in grams)), (words, y))
    sample = list(first.values())
    n = Counter(y for _, y in sample)
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for words, y in sample:
        for token in {t for w in words for t in (w, *(w[:k] for k in range(3, 13) if k <= len(w)))}:
            counts[token][y] += 1
    scores = {}
    for token, (clean, toxic) in counts.items():
        back = 100 * (clean + toxic) / (n[0] + n[1])
        odds = (toxic + back) / (n[1] + 100 - toxic - back), (clean + back) / (n[0] + 100 - clean - back)
        delta = math.log(odds[0] / odds[1])
        if abs(delta) >= 3 * math.sqrt(1 / (toxic + back) + 1 / (clean + back)):
            scores[token] = delta
    assert set(model.scores) == set(scores) and scores
    assert all(model.scores[t] == pytest.approx(s, rel=1e-9) for t, s in scores.items())

    def word(w: str) -> float:
        return scores.get(w) or next((scores[w[:k]] for k in range(min(12, len(w)), 2, -1) if w[:k] in scores), 0.0)

    seen = Counter(round(word(w), 1) for words, y in sample if y == 0 for w in words)
    seen.update({round(s, 1) for s in scores.values()} | {0.0})
    total = sum(seen.values())
    drift = max(0.5, sum(v * m for v, m in seen.items()) / total + 0.5)
    assert model.drift == pytest.approx(drift)
    assert sum(m / total * math.exp(model.lam * (v - drift)) for v, m in seen.items()) == pytest.approx(1.0, abs=1e-6)
    segments = [(max(len(words), 1), top_segments([word(w) - drift for w in words]), y) for words, y in sample]
    weights = [m * math.exp(-model.lam * max((s for *_, s in found), default=0.0)) for m, found, y in segments if y == 0]
    k = n[0] / sum(weights)
    assert model.k == pytest.approx(k, rel=1e-6)
    x = []
    for m, found, _ in segments:
        kept = [s for *_, s in found if 1 - math.exp(-k * m * math.exp(-model.lam * s)) <= model.alpha]
        x.append(math.log1p(sum(max(0.0, model.lam * s - math.log(k * m)) for s in kept)))
    assert (model.weight, model.intercept) == pytest.approx(logistic(x, [y for *_, y in segments], 1e-3), rel=1e-3)


def test_copies_of_the_mix(spark, tables):
    """Rates by bisection, cumulative rounding and the shortest documents' correction, source by source."""
    docs, _ = tables
    got = mixing.mix(spark, docs).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    by_source: dict = defaultdict(list)
    for r in docs.collect():
        by_source[r.source].append(size[r.doc_id])
    targets = mixing_targets({s: sum(v) for s, v in by_source.items()})
    copies: dict = defaultdict(list)
    for r in got:
        copies[r.source, r["size"]].append(r.copies)
    off = classes = 0
    for source, sizes in by_source.items():
        mean, n = sum(sizes) / len(sizes), Counter(sizes)
        rate = lambda lam, z: min(3.0, math.exp(min(lam * z / mean, 2.0))) if z else 0.0
        low, high = -200.0, 200.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(m * z * rate(middle, z) for z, m in n.items()) < targets[source] else (low, middle)
        so_far, given, plan = 0.0, 0, {}
        for z in sorted(n):
            so_far += n[z] * rate(high, z)
            plan[z] = min(3 * n[z], math.floor(so_far + 0.5) - given)
            given = math.floor(so_far + 0.5)
        gap = targets[source] - sum(z * m for z, m in plan.items())
        left = abs(gap)
        for z in sorted(n):
            if z:
                room = (3 * n[z] - plan[z] if gap > 0 else plan[z]) * z
                plan[z] += int(math.copysign(math.floor(min(room, max(0.0, left)) / z), gap))
                left -= room
        for z, m in n.items():
            have = copies[source, z]
            assert len(have) == m and max(have) - min(have) <= 1
            classes += 1
            off += sum(have) != plan[z]
    assert off <= 0.01 * classes  # a cumulative rate that rounds the other way
