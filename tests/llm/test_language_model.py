"""The seating against its exact conditional and a sampler that seats customer by customer; scores against theirs."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import language_model as lm


def exact_conditional(c: int, strength: float, parent: float, d: float) -> np.ndarray:
    """Probabilities of 1 to c tables, by adding up all seatings customer by customer."""
    ways = np.zeros(c + 1)
    ways[1] = 1.0
    k = np.arange(c + 1)
    for n in range(1, c):
        following = ways * np.maximum(n - d * k, 0)
        following[1:] += ways[:-1] * (strength + d * k[:-1]) * parent
        ways = following / following.max()
    return ways[1:] / ways[1:].sum()


@pytest.mark.parametrize("c", [2, 5, 16, 17, 64, 512])
@pytest.mark.parametrize("strength, parent", [(1.0, 0.3), (40.0, 0.01), (5000.0, 0.002)])
def test_small_dishes_follow_their_conditional(c, strength, parent):
    n, d = 40_000, 0.6
    u = (np.arange(n) + 0.5) / n
    t = lm.draw_small(np.full(n, c), np.full(n, strength), np.full(n, parent), d, u)
    want = exact_conditional(c, strength, parent, d)
    got = np.bincount(t.astype(int), minlength=c + 1)[1:] / n
    assert np.abs(got - want).max() < 1e-3


@pytest.mark.parametrize("c", [513, 700, 3000])
@pytest.mark.parametrize("strength, parent", [(1.0, 0.3), (30.0, 0.02), (3000.0, 0.003)])
def test_large_dishes_follow_their_conditional(c, strength, parent):
    """Sweeps of Metropolis-Hastings, and how many of their proposals are taken."""
    n, d = 1000, 0.6
    counts, s, p = np.full(n, float(c)), np.full(n, strength), np.full(n, parent)
    key, memory = lm.mix(np.arange(n, dtype=np.uint64)), lm.Memory.empty(n)
    seen, taken = [], []
    for sweep in range(1, 13):
        before = memory.salt.copy()
        t = lm.reseat(counts, s, p, d, key, sweep, memory)
        if sweep > 2:
            seen.append(t)
            taken.append((memory.salt != before).mean())
    want = exact_conditional(c, strength, parent, d)
    k = np.arange(1, c + 1)
    mean, spread = want @ k, math.sqrt(want @ k**2 - (want @ k) ** 2)
    assert np.mean(seen) == pytest.approx(mean, abs=0.06 * spread)
    assert np.std(seen) == pytest.approx(spread, rel=0.06)
    assert np.mean(taken) > 0.5


def corpus() -> list[tuple[int, str]]:
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)]
    share = 1 / np.arange(1, 41)
    follow = {w: rng.permutation(40) for w in words}
    docs = []
    for d in range(120):
        text, at = [], int(rng.integers(0, 40))
        for _ in range(int(rng.integers(1, 60))):
            at = int(follow[words[at]][rng.choice(40, p=share / share.sum())])
            text.append(words[at])
        docs.append((d, " ".join(text)))
    return docs


def plain_model(train: list[list[str]], d: float, d0: float, theta: float, sweeps: int, burn_in: int):
    """Seats one customer after the other: takes each out and puts it back, in contexts and in their parent.

    Returns the averaged probability of a word after another.
    """
    rng = np.random.default_rng(1)
    customers = [(u, w) for words in train for u, w in zip(["", *words], [*words, ""])]
    vocabulary = len({w for _, w in customers})
    seats: dict[tuple[str, str], list[int]] = defaultdict(list)
    parent: dict[str, list[int]] = defaultdict(list)
    total, tables, dish_tables = Counter(), Counter(), Counter()
    root_total = root_tables = 0

    def root(w):
        n, t = sum(parent[w]), len(parent[w])
        return (n - d0 * t + (theta + d0 * root_tables) / (vocabulary + 1)) / (theta + root_total)

    def put(own, strength, share, discount):
        weights = [x - discount for x in own] + [strength * share]
        at = rng.choice(len(weights), p=np.array(weights) / sum(weights))
        if at == len(own):
            own.append(1)
            return True
        own[at] += 1
        return False

    def take(own):
        at = rng.choice(len(own), p=np.array(own) / sum(own))
        own[at] -= 1
        if not own[at]:
            del own[at]
            return True
        return False

    found: dict = {}
    for sweep in range(sweeps + 1):
        for u, w in customers:
            if sweep:
                total[u] -= 1
                if take(seats[u, w]):
                    tables[u] -= 1
                    root_total -= 1
                    root_tables -= take(parent[w])
            if put(seats[u, w], theta + d * tables[u], root(w), d):
                tables[u] += 1
                root_total += 1
                root_tables += put(parent[w], theta + d0 * root_tables, 1 / (vocabulary + 1), d0)
            total[u] += 1
        if sweep > burn_in:
            for u in {u for u, _ in customers}:
                for w in {w for _, w in customers} | {"never seen"}:
                    own = seats[u, w] if (u, w) in seats else []
                    p = (sum(own) - d * len(own) + (theta + d * tables[u]) * root(w)) / (theta + total[u])
                    found[u, w] = found.get((u, w), 0.0) + p / (sweeps - burn_in)
    return found


def test_scores_equal_a_plain_sampler(spark):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs] + [(500, None, 1, "x")], "doc_id long, text string, kind int, node string")
    held = F.col("doc_id") % 5 == 0
    got = {r.doc_id: r for r in lm.score(spark, frame, held, burn_in=5, samples=30, chunk_tokens=700, node_tokens=500).collect()}
    train = [t.split() for d, t in docs if d % 5]
    pairs = Counter(p for words in train for p in zip(["", *words], [*words, ""]))
    once, twice = (sum(c == n for c in pairs.values()) for n in (1, 2))
    into = Counter(w for _, w in pairs)
    d = lm.discount(once, twice)
    d0 = lm.discount(*(sum(c == n for c in into.values()) for n in (1, 2)))
    probability = plain_model(train, d, d0, 1.0, 150, 30)
    for doc, text in docs:
        words = text.split()
        want = sum(math.log10(probability[p]) for p in zip(["", *words], [*words, ""]))
        assert got[doc].score == pytest.approx(want, abs=0.02 * (len(words) + 1))
    # probabilities after a context add up to one, unknown words included
    vocabulary = {w for _, w in probability} - {"never seen"}
    assert sum(probability["w1", w] for w in vocabulary) + probability["w1", "never seen"] == pytest.approx(1.0, abs=1e-6)
    again = {r.doc_id: r.score for r in lm.score(spark, frame, held, burn_in=5, samples=30, chunk_tokens=5000, node_tokens=5000).collect()}
    assert all(again[i] == pytest.approx(got[i].score, abs=0.02 * got[i].n_tokens) for i in again)
