import random
import re
from collections import Counter

import pytest

from llm import collocations as c


def brute(rows, least, top, scale=1000, absorbed=100):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                for i in range(len(words) - n + 1):
                    f = counts.setdefault(lang, Counter())
                    f[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in candidates.items():
            longer = [
                q for q in candidates if len(q) > len(p) and 100 * candidates[q] >= absorbed * a
                and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if longer:
                continue
            cuts = [(scale * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def found(spark, rows, least, top, extra=False, **more):
    data = [(t, g, 1, "x", 2) for t, g in rows]
    docs = spark.createDataFrame(data, "text string, lang string, n int, phrase string, total long").repartition(3)
    best = c.best_of_each(c.collocations(docs, least=least, **more), top)
    return sorted(tuple(r) for r in best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(seed, n, vocabulary=9, fixed=("new york city hall", "the the the", "ünter dem\x01 x")):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        parts = [rng.choice([*words, *words, *fixed]) for _ in range(rng.randint(0, 60))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", ", "!"]) for p in parts)
        rows.append((text.upper() if i % 7 == 0 else text, rng.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = prose(seed, 60)
    assert found(spark, rows, 5, 2000) == brute(rows, 5, 2000)


def test_cuts_of_the_streams_change_nothing(spark, monkeypatch):
    """With a phrase or two in each range, nearly every phrase reaches over a cut."""
    rows = prose(4, 80, vocabulary=5)
    monkeypatch.setattr(c, "RANGE_ROWS", 2)
    monkeypatch.setattr(c, "SAMPLED", 1000)
    assert found(spark, rows, 4, 2000) == brute(rows, 4, 2000)


def test_chance_hits_of_the_bitmaps_change_nothing(spark, monkeypatch):
    rows = prose(5, 40)
    monkeypatch.setattr(c, "MOST_BITS", 8)
    monkeypatch.setattr(c, "SLICE_BYTES", 50)
    assert found(spark, rows, 5, 2000) == brute(rows, 5, 2000)


def test_top_and_share_of_absorption(spark):
    rows = prose(6, 50)
    assert found(spark, rows, 4, 3) == brute(rows, 4, 3)
    assert found(spark, rows, 4, 50, absorbed=70) == brute(rows, 4, 50, absorbed=70)


def test_products_beyond_64_bits(spark):
    rows = prose(7, 20)
    assert found(spark, rows, 3, 50, scale=10**16) == brute(rows, 3, 50, scale=10**16)


def test_empty_null_long_and_repeated(spark):
    assert found(spark, [], 1, 10) == []
    rows = [(None, "en"), ("", None), ("  \t\n", "en"), ("... !", "en"), ("a b", None), ("a b", "und"), ("A B " * 30000, "en")]
    assert found(spark, rows, 2, 10) == brute(rows, 2, 10)
    assert found(spark, rows * 2, 2, 10) == brute(rows * 2, 2, 10)
