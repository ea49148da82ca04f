"""The classifier sees the whole of long words."""

import random

import numpy as np
import pytest

from gridlore.llm import quality


def plain_rows(word, s):
    import zlib

    marked = f"<{word}>"
    return {zlib.crc32(marked[i : i + 3].encode("utf-32-le"), 1) % s.rows for i in range(len(marked) - 2)}


@pytest.mark.parametrize("n", [39, 41, 4093, 4094, 4095, 9000])
def test_every_n_gram_of_a_word_counts(n):
    s, r = quality.Settings(), random.Random(n)
    word = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    assert set(list(quality.features(word, s))[1:]) == plain_rows(word, s)


def test_what_follows_the_first_40_characters_decides(monkeypatch):
    head, (good, bad) = "x" * 40, ("日本語の文章" * 20, "ABCDEF0123" * 20)
    texts, labels = [f"{head}{good}{i}" for i in range(30)] + [f"{head}{bad}{i}" for i in range(30)], [1] * 30 + [0] * 30
    score = quality.Model(quality.Settings()).fit(texts, labels).scorer()
    assert score(f"{head}{good}new") > 0.6 > 0.4 > score(f"{head}{bad}new")
    monkeypatch.setattr(quality, "ROWS_AT_ONCE", 10)  # a few words at a time in scoring
    assert np.allclose([score(t, quality.Known()) for t in texts], [score(t) for t in texts], atol=1e-9)
