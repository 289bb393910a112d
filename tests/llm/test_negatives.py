import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import negatives as n

SCHEMA = "id long, label int, vector array<double>, score long, rank string, row_id int"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    usable = [
        (i, g, [math.floor(256 * x) for x in v]) for i, g, v in rows
        if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a in sorted({r[0] for r in usable if r[0] % 100 == 0}):
        _, label, vector = min(r for r in usable if r[0] == a)
        scored = [(-sum(x * y for x, y in zip(vector, v)), i, g == label) for i, g, v in usable if i != a]
        for s, i, _ in sorted(x for x in scored if x[2])[:positives]:
            inside = sorted((m, j) for m, j, same in scored if not same and low * -s <= 100 * -m <= high * -s)
            out += [(a, i, rank, j, -s, -m) for rank, (m, j) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in n.mine_negatives(df, F.col("id") % 100 == 0, **more).collect())


def vectors(seed, count=900, size=6, spread=0.3):
    """Clusters with a label each, some rows in the wrong one; every tenth vector is the same."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    rows = []
    for i in range(count):
        g = int(rng.integers(4))
        v = centres[g] + spread * rng.normal(size=size) if i % 10 else centres[0]
        rows.append((i, g if i % 7 else (g + 1) % 4, v.tolist()))
    return rows


@pytest.mark.parametrize("tree", [2, 512])
def test_equals_brute_force(spark, monkeypatch, tree):
    rows = vectors(1)
    monkeypatch.setattr(n, "TREE", tree)
    monkeypatch.setattr(n, "BLOCK_ROWS", 64)
    want = brute(rows)
    assert len(want) > 100 and found(spark, rows) == want


def test_passes_join(spark, monkeypatch):
    rows = vectors(2, count=600)
    monkeypatch.setattr(n, "PASS", 4)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, positives=2, negatives=3, low=50, high=100) == brute(rows, 2, 3, 50, 100)


def test_bounds_spare_rows(spark, monkeypatch):
    """On clustered vectors the bounds leave rows out, and what they leave out does not matter."""
    rows = vectors(3, count=3000, spread=0.02)
    scored = []
    real = n._products
    monkeypatch.setattr(n, "_products", lambda r, a, small: scored.append(len(r)) or real(r, a, small))
    usable = [(i, g, v) for i, g, v in rows]
    anchors = [r for r in usable if r[0] % 100 == 0]
    held = n._Pass(*(np.array([r[c] for r in anchors]) for c in (0, 1)), n._scaled([r[2] for r in anchors], 256.0))
    import pyarrow as pa

    batch = pa.record_batch([pa.array(c) for c in zip(*usable)], ["id", "label", "vector"])
    got = {a: [] for a in range(len(anchors))}
    best = [n._Best(5) for _ in anchors]

    def wanted(a, labels, ids):
        return (labels == held.labels[a]) & (ids != held.ids[a]), best[a].least, np.inf

    monkeypatch.setattr(n, "BLOCK_ROWS", 100)
    batches = [batch.slice(i, 100) for i in range(0, 3000, 100)]
    n._walked(batches, held, 256.0, wanted, lambda a, s, i: (best[a].add(s, i), got[a].extend(i.tolist())))
    assert sum(scored) < 0.5 * 3000 * len(anchors)


def test_nulls_ties_repeats_and_lengths(spark):
    rows = vectors(4, count=300)
    rng = random.Random(4)
    rows += [(None, 1, [1.0] * 6), (500, None, [1.0] * 6), (600, 1, None), (700, 1, [1.0, None]), (800, 2, [float("nan")] * 6)]
    rows += [(900, 2, [float("inf")] * 6), (1000, 2, []), (1001, 2, [0.5]), (1100, 1, [0.5] * 9)]
    rows += [rng.choice(rows[:300]) for _ in range(60)] + [(0, 3, [0.1] * 6), (0, 3, [0.1] * 6)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0])]) == []


def test_products_beyond_doubles(spark):
    rows = [(i, g, [x * 1e6 for x in v]) for i, g, v in vectors(5, count=120)]
    assert found(spark, rows) == brute(rows)
