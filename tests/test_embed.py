"""The hashing encoder against its rule, piece by piece."""

import numpy as np
import pytest
import xxhash

from recollect.operators.embed import HashingEncoder


def by_rule(texts, width):
    out = np.zeros((len(texts), width), np.float32)
    for row, t in zip(out, texts, strict=True):
        for word in (t or "").lower().split():
            padded = f" {word} "
            for piece in (word, *(padded[i : i + 3] for i in range(len(padded) - 2))):
                h = xxhash.xxh64_intdigest(piece)
                row[h % width] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


TEXTS = [None, "", " \t\n", "a", "ab a ab　abc", "İstanbul ΟΔΟΣ Straße", "\U0001f600 x\U0001f600\U0001f601y \U0010ffff", "aaaa" * 50, "é \x00 \x1f \x85 |", *(f"w{i} w{i % 7} the" for i in range(60)), " ".join(f"v{i}" for i in range(300))]


@pytest.mark.parametrize("width", [1, 64, 100])
@pytest.mark.parametrize("bounds", [{}, {"portion": 1}, {"portion": 5, "letters": 3, "kept_words": 7}, {"portion": 16, "kept_words": 3, "letters": 1}, {"portion": 50, "kept_letters": 20, "letters": 7}])
def test_hashing_is_the_rule(width, bounds):
    e = HashingEncoder(width)
    for name, x in bounds.items():
        setattr(e, name, x)
    encode = e.open()
    for texts in (TEXTS, TEXTS[::-1], []):  # the second time some words are known
        assert np.array_equal(encode(texts), by_rule(texts, width))


def test_words_are_hashed_once(monkeypatch):
    calls, hashed = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: calls.append(x) or hashed(x))
    encode = HashingEncoder().open()
    encode(["hola mundo " * 1000] * 3)
    assert len(calls) <= 11  # two words and nine triples
    encode(["mundo hola"])
    assert len(calls) <= 11
