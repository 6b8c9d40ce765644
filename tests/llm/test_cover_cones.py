"""Blocks of mutually close vectors against brute force."""

from __future__ import annotations

import numpy as np

from ledgerline.llm import cover


def brute_counts(x, cosine):
    hit = x @ x.T >= cosine
    np.fill_diagonal(hit, False)
    return hit.sum(axis=1).tolist()


def test_links_taken_whole_count_once():
    rng = np.random.default_rng(3)
    cones = [np.c_[np.cos(a), np.sin(a)] for a in [np.radians([0, 2.9, 8.6, 11.5])]]
    for n, spread in ((40, 0.02), (60, 0.1), (80, 0.25), (100, 0.4)):
        v = np.array([1.0, 0, 0, 0]) + rng.normal(0, spread, (n, 4))
        cones.append(v / np.linalg.norm(v, axis=1, keepdims=True))
    for x in cones:
        for cosine in (0.95, 0.99):
            tree = cover.cover_tree(x, float(np.sqrt(2 - 2 * cosine)))
            assert cover.dual_links(x, tree, x, tree, cosine, True).counts.tolist() == brute_counts(x, cosine)
            a, b = x[::2], x[1::2]
            ta, tb = (cover.cover_tree(y, float(np.sqrt(2 - 2 * cosine))) for y in (a, b))
            hit = a @ b.T >= cosine
            assert cover.dual_links(a, ta, b, tb, cosine, False).counts.tolist() == hit.sum(axis=1).tolist() + hit.sum(axis=0).tolist()


def test_three_angles():
    x = np.array([[np.cos(a), np.sin(a)] for a in (2.12998, 2.18615, 1.97887)])
    tree = cover.cover_tree(x, float(np.sqrt(0.1)))
    assert cover.dual_links(x, tree, x, tree, 0.95, True).counts.tolist() == [2, 2, 2]


def _components(n, hit):
    root = list(range(n))
    for i, j in np.argwhere(hit):
        a, b = min(root[i], root[j]), max(root[i], root[j])
        root = [a if r == b else r for r in root]
    return root


def test_counts_and_forests_in_many_dimensions():
    rng = np.random.default_rng(11)
    for trial in range(400):
        dims = int(rng.choice([2, 2, 3, 4, 8, 16, 64]))
        n = int(rng.integers(2, 60))
        centres = rng.normal(0, 1, (int(rng.integers(1, 6)), dims))
        v = centres[rng.integers(0, len(centres), n)] + rng.normal(0, float(rng.choice([0.0, 0.05, 0.2, 1.0])), (n, dims))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        cosine = float(rng.choice([0.8, 0.95, 0.99]))
        near = np.abs(v @ v.T - cosine).min() < 1e-9  # rounding decides such pairs; none may be left to it
        if near:
            continue
        tree = cover.cover_tree(v, float(np.sqrt(2 - 2 * cosine)))
        links = cover.dual_links(v, tree, v, tree, cosine, True)
        assert links.counts.tolist() == brute_counts(v, cosine)
        hit = np.triu(v @ v.T >= cosine, 1)
        forest = np.zeros((n, n), dtype=bool)
        for i, j in links.edges:
            forest[i, j] = True
            assert hit[min(i, j), max(i, j)]
        assert _components(n, forest) == _components(n, hit)
        half = n // 2
        if half:
            a, b = v[:half], v[half:]
            ta, tb = (cover.cover_tree(y, float(np.sqrt(2 - 2 * cosine))) for y in (a, b))
            between = a @ b.T >= cosine
            assert cover.dual_links(a, ta, b, tb, cosine, False).counts.tolist() == between.sum(axis=1).tolist() + between.sum(axis=0).tolist()


def test_threshold_itself_links(spark):
    """cos = 3/5 * 1 + 4/5 * 0 is met exactly at a threshold of 0.6; repeated and odd rows."""
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [1.0]), (8, [1.0, 0.0]), (8, [-3.0, 0.1]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, component_id long, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover.near_duplicates(spark, frame, cosine=0.6).filter("vec_id is not null").collect()}
    assert {i: got[i] for i in (2, 4, 5, 6, 7)} == {2: (2, 1, False), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True)}
    assert got[1][1:] == (1, True) and got[8][1] == 1 and got[3][1] == 1
