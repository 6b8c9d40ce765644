"""Bundles of blocks that meet in rounds: exact links, and a disk that stays in proportion to the table."""

from __future__ import annotations

import os
import threading

import numpy as np
import pytest

from ledgerline.llm import cover


def frame(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def brute(vectors, cosine):
    """(links, smallest id reachable) of each vector."""
    root = list(range(len(vectors)))
    counts = [0] * len(vectors)
    for i, v in enumerate(vectors):
        for j in range(i):
            if len(v) == len(vectors[j]) and float(v @ vectors[j]) / (np.linalg.norm(v) * np.linalg.norm(vectors[j])) >= cosine:
                counts[i], counts[j] = counts[i] + 1, counts[j] + 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return list(zip(counts, root))


@pytest.mark.parametrize("n, block, step, most", [(400, 60, 1, 10), (400, 8, 16_000, 1 << 22), (330, 40, 700, 50), (1, 8, 1, 1)])
def test_rounds_find_every_link(spark, n, block, step, most):
    """Odd and even numbers of bundles, one round a job or several, findings folded or not, two lengths of vectors."""
    rng = np.random.default_rng(n + step)
    lead = rng.normal(0, 1, (max(1, n // 6), 12))
    v = (lead[rng.integers(0, len(lead), n)] + rng.normal(0, 0.12, (n, 12))).astype(np.float32).astype(float)
    vectors = [x if i % 5 else x[:5] for i, x in enumerate(v)]
    found = cover.near_duplicates(spark, frame(spark, vectors), block_rows=block, moved=step, most=most).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert len(found) == n and [got[i] for i in range(n)] == [(c, root, root == i) for i, (c, root) in enumerate(brute(vectors, 0.95))]


def test_shuffle_files_stay_in_proportion(spark):
    """48 blocks: the pairs of blocks moved at once were 48 times the vectors."""
    n, dims = 3000, 64
    vectors = frame(spark, np.random.default_rng(1).normal(0, 1, (n, dims)).astype(np.float32))
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def held() -> int:
        total = 0
        for top in folders:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.startswith("shuffle_"):
                        try:
                            total += os.path.getsize(os.path.join(folder, name))
                        except OSError:  # it went meanwhile
                            pass
        return total

    before, peak, done = held(), [0], threading.Event()

    def watch() -> None:
        while not done.wait(0.02):
            peak[0] = max(peak[0], held() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert cover.near_duplicates(spark, vectors, block_rows=64, moved=n).count() == n
    finally:
        done.set()
        watcher.join()
    assert 0 < peak[0] < 12 * n * dims * 4
