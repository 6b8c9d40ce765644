"""Plain versions that the operators and the pipeline stages are held against."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def smallest_reachable(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text: str | None, width: int) -> int:
    """Bit by bit majority over the shingles of ``width`` words."""
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        bits.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


def mixing_targets(by_source: dict) -> dict:
    """Targets of sources by resharing the excess until none is above three times its size."""
    order = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [s for s in by_source if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(by_source.values()), {}
    while True:
        left = total - sum(capped.values())
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: left * weight[s] / share for s in order if s not in capped}
        over = {s: 3.0 * by_source[s] for s in target if target[s] > 3 * by_source[s]}
        if not over:
            return target | capped
        capped |= over


def top_segments(scores) -> list[tuple[int, int, float]]:
    """The best segment, then the best on either side of it, and so on while any is positive."""
    prefix = np.r_[0.0, np.cumsum(scores)]
    found, todo = [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        part = prefix[a : b + 1]
        gain = part - np.minimum.accumulate(part)
        j = int(gain.argmax())
        if gain[j] > 1e-9:
            i = int(part[:j].argmin())
            found.append((a + i, a + j - 1, float(gain[j])))
            todo += [(a, a + i), (a + j, b)]
    return found
