"""Plain versions of the operators for small tables of {doc_id: text}."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def equal_texts(docs):
    """The largest id of each class of equal texts."""
    last = {}
    for i in sorted(docs):
        last[lower(docs[i])] = i
    return sorted(last.values())


def linked(docs, k, percent):
    """The smallest id that each id reaches by links."""
    sets, top = {}, {i: i for i in docs}
    for i, t in docs.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((find(i), find(j)))
                top[high] = low
    return {i: find(i) for i in ids}


def without_repeats(docs, window):
    """Texts without the words that a window of an earlier text covers; others as they are."""
    words, first = {i: WORD.findall(t or "") for i, t in docs.items()}, {}
    for i in sorted(docs):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else docs[i]
    return out
