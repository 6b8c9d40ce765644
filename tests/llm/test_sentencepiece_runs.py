"""Long texts without word borders against the library."""

from __future__ import annotations

import time

import numpy as np
import pytest


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import sentencepiece

    from ledgerline.llm.sentencepiece import Codec, load_vocabulary

    path = public_tokenizers.path("piece_bpe_32k.model")
    return Codec(load_vocabulary(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def letters(n: int) -> str:
    return "".join(np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyzé漢0"), n))


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 300_000, "\n" * 300_000, " \t" * 200_000, letters(1_000_000), "=-" * 150_000], ids=["spaces", "one letter", "lines", "tabs", "letters", "rules"])
def test_long_runs(both, text):
    codec, library = both
    start = time.monotonic()
    ids = codec.encode([text])[0]
    took = time.monotonic() - start
    assert ids.tolist() == library.encode(text)
    assert codec.decode(ids) == library.decode(ids.tolist())
    assert took < 60


def test_lengths_about_the_border(both):
    codec, library = both
    for n in (510, 511, 512, 513, 514, 1500):
        for text in (" " * n, letters(n), "ab" * n, "the " * n, " " * n + letters(n)):
            assert codec.encode([text])[0].tolist() == library.encode(text)
