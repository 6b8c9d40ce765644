"""Sets of word shingles and their similarity."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles, ascending; made from the XXH64 of the words."""
    from xxhash import xxh64_intdigest

    tokens = text.encode().translate(LOWER).split() if text else []
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    hashes = np.array([xxh64_intdigest(t, seed) for t in tokens], dtype=np.uint64)
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    made = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        made = (made ^ (made >> np.uint64(29))) * FACTOR + hashes[k : k + n]
    made = (made ^ (made >> np.uint64(32))) * MIX
    return np.unique(made ^ (made >> np.uint64(32)))


def similar(x: np.ndarray, y: np.ndarray, least: Fraction) -> bool:
    """Whether two sets' Jaccard similarity is at least ``least``."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * least.denominator >= least.numerator * (len(x) + len(y) - common)
