"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every query and the pipeline."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from ledgerline.llm import queries

ALL = {**queries.queries(), "pipeline": corpus_pipeline.run}
LONG = "lorem ipsum dolor sit amet " * 20000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `count` long, size long, fp string, y int, `__id` long"
ROWS = [
    (1, "a plain text of some words", "en", "src0", 26, 1, 1, "x", 1, 1),
    (1, "a plain text of some words", "en", "src0", 26, 1, 1, "x", 1, 1),
    (2, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "src1", 0, 0, 0, "", 0, 0),
    (4, LONG, "en", "src1", len(LONG), 2, 2, "y", 0, 9),
    (5, "a plain text of some words", "de", "src2", 26, 3, 3, "z", 0, 8),
    (6, " \t\n ", "fr", "src2", 4, 3, 3, "z", 0, 7),
    (None, "a text without an id", "fr", None, 4, 3, 3, "z", 0, 7),
    (7, "x" * 200_000, "fr", "src2", 4, 3, 3, "z", 0, 7),
    (8, " " * 200_000 + "end", "fr", "src2", 4, 3, 3, "z", 0, 7),
]
LABELS = [(i, i % 2, (i // 2) % 2) for i in (1, 2, 3, 4, 5, 6)] + [(None, 1, 0), (1, None, None)]
LABELS = [(*label, "text", 1, "lang") for label in LABELS]
# further columns bear names that the operators use themselves
PAGES = [(1, None, None), (2, "no scheme", ""), (3, "http://A.net/", "<p>" * 900), (4, "http://b.org/fr/x?y=1", "<p>" * 900), (5, "https://", "z"), (5, "http://A.net/", "z"), (None, "http://c.com/", "z")]
PAGES = [(*p, "host", "path", "rule", "digest", b"payload", 1) for p in PAGES]
VECTORS = [(0, [1.0, 0.0], 1), (50, [1.0, 0.001], 1), (100, None, 0), (150, [0.0, 0.0], 0), (200, [float("nan"), 1.0], 0), (250, [None, 1.0], 0), (300, [-1.0, 0.5], None)]
VECTORS = [(*v, 1, 2, [1.0], 3, 4, "block") for v in [*VECTORS, (None, [0.0, 1.0], 1), (350, [0.0, -1.0], 1), (350, [0.0, -1.0], 1)]]


def _write(spark, path, n):
    tables = {
        "documents": (ROWS, DOCS),
        "labels": (LABELS, "doc_id long, quality int, toxic int, text string, y int, lang string"),
        "pages": (PAGES, "page_id long, url string, html string, host string, path string, rule string, digest string, payload binary, size int"),
        "embeddings": (VECTORS, "vec_id long, embedding array<float>, label int, id int, n int, v array<double>, dims int, key int, block string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows[:n], schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("odd"), None)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), 0)


@pytest.mark.parametrize("name", list(ALL))
def test_odd_rows(spark, odd, name):
    got = ALL[name](spark, odd).collect()
    if name in ("op1_sentencepiece", "op2_language_model", "op5_toxicity", "op7_mixing", "op9_quality"):
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    if name == "op1_sentencepiece":
        assert {r.doc_id: r.n_tokens for r in got}[2] == {r.doc_id: r.n_tokens for r in got}[3] == 0
    if name == "op2_language_model":
        assert {r.doc_id: r.n_tokens for r in got}[2] == 1 and all(r.score < 0 for r in got)
    if name == "op3_cover":
        found = Counter((r.vec_id, r.n_links) for r in got)
        assert found == Counter([(0, 1), (50, 1), (100, 0), (150, 0), (200, 0), (250, 0), (300, 0), (None, 0), (350, 2), (350, 2)])
    if name == "op4_topk":
        assert {r.query_id for r in got} == {0, 50, 150, 300, 350} and all(None not in r for r in got)
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 150] == [(0, 0), (50, 0), (300, 0), (350, 0), (350, 0)]
    if name == "op6_urls":
        assert Counter((r.page_id, r.rule) for r in got) == Counter([(1, None), (2, None), (3, "net/"), (4, "org/fr/"), (5, None), (5, "net/"), (None, None)])
    if name == "op7_mixing":
        assert all(0 <= r.taken <= 3 * r.size for r in got) and {r.doc_id: r.size for r in got}[4] == 100_000
    if name == "op8_simhash":
        found = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
        assert set(found) == {None, 1, 2, 3, 4, 5, 6, 7, 8} and found[5][1] == 1
        assert found[2] == found[3] == found[6] == ("0" * 16, 2)
    if name == "op10_warc":
        found = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
        assert found == Counter([(1, "response", None, 0), (2, "response", None, 0), (3, "revisit", 4, 2700), (4, "response", None, 2700), (5, "response", None, 1), (5, "response", None, 1), (None, "response", None, 1)])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_of_stages(spark, odd, name, stage):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    made = stage(spark, docs, odd)
    got = made.collect()
    if name != "sentencepiece":
        assert made.columns == docs.columns and set(map(tuple, got)) <= set(ROWS)
    if name == "near_copies":
        # the smaller id of equal texts, all rows of a repeated id, texts without words once, rows without an id
        assert Counter(r.doc_id for r in got) == Counter([1, 1, 2, 4, None, 7, 8])
    if name == "mixing":
        assert max(Counter(map(tuple, got)).values()) <= 3 * 2  # a repeated row is two rows
    if name == "sentencepiece":
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS) and all(r.round_trip for r in got)
    empty = docs.limit(0)
    assert stage(spark, empty, odd).collect() == []


@pytest.mark.parametrize("name", list(ALL))
def test_empty_tables(spark, empty, name):
    assert ALL[name](spark, empty).collect() == []
