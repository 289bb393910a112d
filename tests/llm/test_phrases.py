import hashlib
import random
import re

import pytest

from llm.phrases import repeated_passages

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    first = {}
    for i, w in texts:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts(seed=3):
    rnd = random.Random(seed)
    words = lambda n, v=5000: [f"w{rnd.randrange(v)}" for _ in range(n)]
    passages = [words(n) for n in (50, 51, 60, 75, 120, 49)]
    out = []
    for _ in range(120):
        text = []
        for _ in range(rnd.randrange(4)):
            text += words(rnd.randrange(40))
            p = rnd.choice(passages)
            cut = rnd.randrange(0, 20)
            text += p[cut:] if rnd.random() < 0.3 else p
        out.append(" ".join(text + words(rnd.randrange(30))))
    base = words(300)
    for _ in range(25):
        copy = list(base)
        for _ in range(rnd.randrange(5)):
            copy[rnd.randrange(300)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(copy))
    out += ["z " * 400, "z " * 401, "z y " * 90, "y z " * 90, "z " * 60 + "q", None, "", " \n", "short text", "É é " * 40, "é É " * 40]
    out += [out[3], out[-1], out[125], "  ".join(out[126].split(" ")), " ".join(words(3000))]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("window", [50, 16])
def test_matches_brute_force(documents, window):
    rows = list(enumerate(texts())) + [(None, texts()[4])]
    rows += [rows[7], rows[30]]  # repeated rows
    got = []
    for r in repeated_passages(documents(rows).repartition(3), window=window).collect():
        sha = r.words_sha256 if r.kept is None else hashlib.sha256(r.kept.encode()).hexdigest()
        got.append((r.id, r.n_words, sum(s.stop - s.start for s in r.removed), sha))
    assert sorted(got, key=repr) == brute(rows, window)


def test_empty_table(documents):
    assert repeated_passages(documents([])).collect() == []
