import hashlib
from collections import defaultdict

from llm.exact import digest_rows, digest_state, exact_groups

from llm.common import landed

ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "other"), (4, None), (5, ""), (6, "same text"), (7, "É"), (8, "é"),
    (9, "x" * 50_000), (10, "X" * 50_000), (3, "other"), (None, "lone"),
]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_matches_brute_force(documents):
    assert got(exact_groups(documents(ROWS))) == brute(ROWS)


def test_batches_of_files_give_the_same_groups(documents):
    assert got(exact_groups(documents(ROWS).repartition(6), batches=3)) == brute(ROWS)
    assert got(exact_groups(documents([]), batches=3)) == []


def test_empty_table(documents):
    assert got(exact_groups(documents([]))) == []


def test_state_grows_over_several_batches(spark, documents):
    rows = landed(digest_rows(documents(ROWS).repartition(4), "doc_id", "text"), "test-digests")
    state = digest_state(rows, files_per_trigger=1)
    want = {(h, n) for _, _, n, _, h in brute(ROWS)}
    assert {(r.digest, r.group_size) for r in state.collect()} == want
