import math
import random
import re
from collections import Counter

import pytest

from llm import queries, words
from llm.lm import stupid_backoff

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, order, min_count=2, backoff=0.4):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    counts = Counter(tuple(w[j : j + n]) for _, w in texts for n in range(1, order + 1) for j in range(len(w) - n + 1))
    total = sum(len(w) for _, w in texts)

    def score(gram):
        if len(gram) == 1:
            return counts[gram] / total
        if counts[gram] >= min_count:
            return counts[gram] / counts[gram[:-1]]
        return backoff * score(gram[1:])

    out = []
    for i, w in texts:
        out.append((i, len(w), sum(math.log(score(tuple(w[max(0, j - order + 1) : j + 1]))) for j in range(len(w)))))
    return sorted(out, key=repr)


def texts():
    rnd = random.Random(2)
    out = [" ".join(f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(rnd.randrange(60))) for _ in range(300)]
    out += [None, "", " \t", "One", "É é É", "hot pair " * 4000, "a\tb\nc", "w1 w2"] + ["the same text"] * 200
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_brute_force(documents, monkeypatch, order):
    monkeypatch.setattr(words, "SLICE_BYTES", 5000)
    rows = list(enumerate(texts())) + [(0, "again w1"), (None, "no id"), (3, texts()[3]), (None, "no id"), (None, None), (None, None)]
    got = sorted(map(tuple, stupid_backoff(documents(rows), order=order).collect()), key=repr)
    want = brute(rows, order)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-7) for a, b in zip(got, want))


def test_empty_table(documents):
    assert stupid_backoff(documents([])).collect() == []


def test_registered_query_counts_trigrams(documents, tmp_path):
    rows = [(1, "a b c d"), (2, "a b c"), (3, "x b d"), (4, "b d b d a"), (5, None)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op7_lm_scoring_order3"](documents([]).sparkSession, str(tmp_path)).collect()))
    want = brute(rows, 3)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(got, want))
    assert any(abs(a[2] - b[2]) > 0.1 for a, b in zip(got, brute(rows, 2)))
