import random
import re

import pytest

from llm.components import components
from llm import jaccard
from llm.jaccard import linked_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(low)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                top[high] = low
    return sorted((i, len(sets[i]), find(i)) for i, _ in rows)


def family(seed, n, words=80, changes=8):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(3000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rnd.randrange(changes)):
            copy[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def texts():
    rnd = random.Random(1)
    out = family(2, 120) + family(3, 40, words=12, changes=2) + family(4, 30, words=300, changes=20)
    out += [" ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(12))) for _ in range(150)]
    out += [None, "", "  \t ", "One", "one", "two words", "TWO  words", "é É", "a b c", "A\tB\nC d", "z " * 4000, "z " * 4001]
    out += ["common passage of several words " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(5)) for _ in range(60)]
    rnd.shuffle(out)
    return out + [out[0], out[1], out[1].upper() if out[1] else None]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_matches_brute_force(documents, k, percent):
    rows = list(enumerate(texts()))
    got = linked_classes(documents(rows).repartition(3), k=k, percent=percent).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, percent)


def test_empty_and_tiny_tables(documents):
    assert linked_classes(documents([])).collect() == []
    assert sorted(map(tuple, linked_classes(documents([(7, "a"), (8, None)])).collect())) == [(7, 1, 7), (8, 0, 8)]


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(2001, 2000), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(50)} == {1000} and got[2001] == 2000


def test_ordering_shingles_are_the_most_frequent_and_bounded(documents, monkeypatch):
    spark = documents([]).sparkSession
    often = spark.createDataFrame([(t, 5 if t % 2 else 7) for t in range(4000)] + [(9000, 99)], "token long, n long")
    monkeypatch.setattr(jaccard, "ORDERED", 3000)
    got = [r.n for r in jaccard._top(often).collect()]
    assert (got.count(99), got.count(7), got.count(5)) == (1, 2000, 999)
    monkeypatch.setattr(jaccard, "MANY", 6)
    got = [r.n for r in jaccard._top(often).collect()]
    assert got.count(5) == 999 and len(got) == 3000
    monkeypatch.setattr(jaccard, "ORDERED", 9000)
    assert jaccard._top(often).count() == 4001
