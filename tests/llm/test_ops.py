"""Each operator's query against a plain version of its contract, over whole tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import oracle
from ledgerline.llm import queries
from plain import WORD, fingerprint, lower, mixing_targets, smallest_reachable


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)


def test_sentencepiece_equals_library(spark, sf, documents):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = queries.op1_sentencepiece(spark, sf).collect()
    assert len(got) == len(documents)
    for r in got:
        ids = library.encode(documents[r.doc_id].text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_language_model(spark, sf, documents):
    tokens = {d: [*WORD.findall(lower(r.text or "")), None] for d, r in documents.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in documents}
    counts = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    got = queries.op2_language_model(spark, sf).collect()
    assert len(got) == len(documents)
    gain = n = 0
    for r in got:
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ts), total)
        assert r.n_known == sum(t in counts for t in ts)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in ts)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
        if r.held_out:
            gain, n = gain + r.score - r.base_score, n + r.n_tokens
    assert gain / n > 0.05


def test_cover_tree_finds_exact_links(spark, sf, vectors):
    ids, x = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))
    order = np.argsort(ids)
    rank = np.empty(len(ids), dtype=int)
    rank[order] = np.arange(len(ids))
    roots = smallest_reachable(len(ids), [(rank[a], rank[b]) for a, b in close])
    links = Counter(close.ravel().tolist())
    got = {r.vec_id: r for r in queries.op3_cover(spark, sf).collect()}
    assert len(got) == len(ids)
    for i, v in enumerate(ids):
        component = ids[order][roots[rank[i]]]
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (links[i], component, v == component)


def test_top_k_is_exact(spark, sf, vectors):
    ids, x = vectors
    q = np.floor(256 * x).astype(np.int64)
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        scores = q @ q[i]
        others = sorted((-scores[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:5]
        want += [(ids[i], k, v, -s) for k, (s, v) in enumerate(others, 1)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in queries.op4_topk(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def _auc(scores, y):
    scores, y = np.asarray(scores), np.asarray(y)
    up, down = scores[y == 1], scores[y == 0]
    return ((up[:, None] > down).mean() + 0.5 * (up[:, None] == down).mean()) if len(up) and len(down) else 1.0


@pytest.mark.parametrize(
    "query, label, parts, held, cut", [("op5_toxicity", "toxic", 3, 1, 0.7), ("op9_quality", "quality", 5, 0, 0.3)]
)
def test_classifiers_on_held_out_labels(spark, sf, documents, query, label, parts, held, cut):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in getattr(queries, query)(spark, sf).collect()}
    assert set(got) == set(documents)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % parts == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    test = [d for d in labels if got[d].held_out and labels[d] is not None]
    right = np.mean([got[d].predicted == labels[d] for d in test])
    auc = _auc([got[d].score for d in test], [labels[d] for d in test])
    print(query, "held-out accuracy", right, "auc", auc, "n", len(test))
    assert right >= 0.85 and auc >= 0.9


def test_url_rules(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    got = queries.op6_urls(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        found = re.search(r"(?s)://([^/?#]*)([^?#]*)", pages[r.page_id] or "")
        host, path = (lower(found[1]), found[2]) if found else ("", "")
        fits = [t for t in rules if (host == t[1] or host.endswith("." + t[1])) and path.startswith(t[2])]
        best = max(fits, key=lambda t: len(t[1] + t[2]), default=None)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (best[1] + best[2] if best else None)
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


def test_mixing_meets_targets(spark, sf, documents):
    sizes = {d: len(WORD.findall(r.text or "")) for d, r in documents.items()}
    by_source = Counter()
    for d, r in documents.items():
        by_source[r.source] += sizes[d]
    target = mixing_targets(by_source)
    got = queries.op7_mixing(spark, sf).collect()
    taken = Counter()
    for r in got:
        source = documents[r.doc_id].source
        assert (r.size, r.source_size) == (sizes[r.doc_id], by_source[source])
        assert r.target == pytest.approx(target[source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for source in target:
        assert taken[source] == pytest.approx(target[source], rel=0.02)


def test_simhash_links_all(spark, sf, documents):
    ids = sorted(documents)
    prints = [fingerprint(documents[d].text, 3) for d in ids]
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = smallest_reachable(len(ids), pairs)
    got = {r.doc_id: r for r in queries.op8_simhash(spark, sf).collect()}
    assert set(got) == set(ids)
    for i, d in enumerate(ids):
        assert (got[d].fingerprint, got[d].component_id) == (f"{prints[i]:016x}", ids[roots[i]])


def test_warc_equals_sql(spark, sf):
    assert oracle.expect_same(queries.op10_warc(spark, sf), oracle.connect(sf), queries.oracle_sql()["op10_warc"]) > 0
