"""Words found on bytes, and the hashes of terms."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from alertloom.operators import vectors


def plain(text):
    points = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in text)
    return [w for w in re.split(" +", points) if len(w) > 1]


@pytest.mark.parametrize("seed", range(20))
def test_words_of_any_alphabet(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab_1 .,éß中文𝔘😀́٣\n") for _ in range(rng.randrange(14))) for _ in range(30)]
    for column, expected in ((pa.array(texts), texts), (pa.array(texts).slice(3, 9), texts[3:12])):
        words, counts = vectors._words(column)
        assert words.to_pylist() == [w for t in expected for w in plain(t)]
        assert counts.tolist() == [len(plain(t)) for t in expected]


def test_texts_are_not_decoded_as_a_whole(monkeypatch):
    """Only code points beyond ASCII are looked up one by one."""
    looked_up = []

    class Points(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                looked_up.append(at.size)
            return np.asarray(self)[at]

    monkeypatch.setattr(vectors, "_word_points", lambda points=vectors._word_points(): points.view(Points))
    words, _ = vectors._words(pa.array(["plain words " * 100 + "é ça"]))
    assert len(words) == 201 and sum(looked_up) == 2


def test_hashes_tell_terms_apart_and_do_not_depend_on_the_slice():
    terms = [f"{a}{b}" for a in ("x", "é", "中", "") for b in range(5000)] + [""]
    found = vectors._hashes(pa.array(terms))
    assert found.dtype == np.uint64 and len(np.unique(found)) == len(terms)
    assert np.array_equal(vectors._hashes(pa.array(terms).slice(7, 90)), found[7:97])
    slots = np.bincount(((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(int), minlength=256)
    assert slots.max() < 3 * slots.mean() and not len(vectors._hashes(pa.array([], pa.string())))
