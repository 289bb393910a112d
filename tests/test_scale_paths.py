"""The ways taken for large tables, forced on small ones and checked by brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.operators import quality, ranking, splits, vectors
from alertloom.operators.quantiles import column_quantiles


def test_row_ids_follow_the_order(spark):
    df = spark.range(0, 5000, 1, 16).select(((F.col("id") * 7919) % 5000).alias("k"))
    got = {r["k"]: r["row_id"] for r in ranking.with_row_id(df, ["k"]).collect()}
    assert got == {k: k for k in range(5000)}


def test_large_tables_are_indexed_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(g, f"v{i:03d}") for g in "abc" for i in range(40 if g == "a" else 5)], "g string, v string")
    small = sorted(map(tuple, ranking.index_within(df, ["g"], ["v"], "i").collect()))
    monkeypatch.setattr(ranking, "is_small", lambda t: False)
    assert sorted(map(tuple, ranking.index_within(df, ["g"], ["v"], "i").collect())) == small
    alone = ranking.index_within(df.where("g = 'a'"), [], ["v"], "i").orderBy("i").collect()
    assert [r["v"] for r in alone] == [f"v{i:03d}" for i in range(40)]


@pytest.mark.parametrize("shape", ["normal", "ties", "two"])
def test_narrowed_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(size=30_000),
        "ties": np.where(rng.random(30_000) < 0.4, 1.5, rng.normal(size=30_000)),
        "two": np.repeat([1.0, 2.0], 5_000),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(4)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = column_quantiles(df, {"v": probs}, distinct_limit=1 if shape == "two" else 20)["v"]
    assert got.rows == len(values)
    for p in probs:
        assert got.quantiles[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def brute_split(rows, seed, sizes):
    """(key -> label) by sorting each stratum on the seeded hash."""
    strata = defaultdict(list)
    for k, s in rows:
        strata[s].append((hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    labels = {}
    for s, members in strata.items():
        members.sort()
        at = 0
        for label, n in sizes[s]:
            for _, k in members[at : at + n]:
                labels[k] = label
            at += n
    return labels


@pytest.mark.parametrize("per_bucket", [200_000, 40])
def test_assignment_equals_a_full_sort(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(splits, "ROWS_PER_BUCKET", per_bucket)
    rows = [(k, "hot" if k % 3 else ("rare" if k % 30 == 0 else None)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, s string")
    sizes = {"hot": [("a", 500), ("b", 0), ("c", 1500)], "rare": [("a", 0), ("b", 60), ("c", 40)], None: [("a", 1), ("b", 2), ("c", 3)]}
    quotas = spark.createDataFrame([(s, *[n for _, n in parts]) for s, parts in sizes.items()], "stratum string, a bigint, b bigint, c bigint")
    got = splits.assign(df, ["k"], 42, "s", quotas, [("a", "a"), ("b", "b"), ("c", "c")], 3000)
    want = brute_split(rows, 42, sizes)
    assert {r["k"]: r["split"] for r in got.collect() if r["split"]} == want


def test_split_sizes_and_errors(spark):
    df = spark.range(1001).select("id", F.when(F.col("id") % 10 < 7, "x").when(F.col("id") % 10 < 9, "y").otherwise("z").alias("s"))
    got = splits.split_train_val_test(df, ["id"], "s")
    total = Counter(r["split"] for r in got.collect())
    assert total == {"test": 201, "validation": 150, "train": 650}
    shares = {(r["s"], r["split"]): r["count"] for r in got.groupBy("s", "split").count().collect()}
    assert shares[("x", "test")] in (140, 141, 142) and shares[("z", "test")] in (20, 21)
    again = splits.split_train_val_test(df.repartition(7), ["id"], "s")
    assert got.exceptAll(again).isEmpty()
    assert not got.exceptAll(splits.split_train_val_test(df, ["id"], "s", seed=1)).isEmpty()
    lone = df.withColumn("s", F.when(F.col("id") == 0, "one").otherwise(F.col("s")))
    with pytest.raises(ValueError):
        splits.split_train_val_test(lone, ["id"], "s")
    plain = splits.split_train_test(df, ["id"], "absent")
    assert Counter(r["split"] for r in plain.collect()) == {"test": 201, "train": 800}
    assert splits.split_bounds_ok(0.2, 0.15) and not splits.split_bounds_ok(0.05, 0.15)


def test_exact_split_leaves_the_rest(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("s"))
    got = Counter(r["split"] for r in splits.split_exact(df, ["id"], "s", 1000, 300, 50).collect())
    assert got == {"train": 1000, "validation": 300, "test": 50, None: 650}


def test_folds_are_balanced(spark):
    df = spark.range(503).select("id", F.when(F.col("id") % 11 == 0, "r").otherwise("c").alias("s"))
    folds = splits.kfold(df, ["id"], 5, 42, "s")
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sum(sizes) == 503 and max(sizes) - min(sizes) <= 1
    for s in "rc":
        part = [r["count"] for r in folds.where(F.col("s") == s).groupBy("fold").count().collect()]
        assert len(part) == 5 and max(part) - min(part) <= 1


def test_codes_of_large_tables_are_joined_the_same(spark, monkeypatch):
    train = spark.createDataFrame([("b", "x"), ("a", None), ("c", "y")], "p string, q string")
    test = spark.createDataFrame([("c", "y"), ("new", None), (None, "zz")], "p string, q string")
    codes = vectors.fit_ordinal(train, ["p", "q"])
    small = vectors.ordinal_encode(test, codes, ["p", "q"])
    want = [(2, 2), (0, 0), (0, 0)]
    assert sorted(map(tuple, small.collect())) == sorted(want)
    monkeypatch.setattr(vectors, "is_small", lambda t: False)
    assert sorted(map(tuple, vectors.ordinal_encode(test, codes, ["p", "q"]).collect())) == sorted(want)


def test_message_level_with_a_hot_message(spark):
    rows = [(1 if i % 3 else i, i, None if i < 10 else f"t{i}", "a" if i % 2 else "b") for i in range(300)]
    rows.append((None, 999, "t", "a"))
    df = spark.createDataFrame(rows, "m bigint, k bigint, text string, d string")
    hits, messages = quality.to_message_level(df, "m", ["k"], ["d"])
    got = {r["m"]: r for r in messages.collect()}
    assert hits.count() == 301 and None not in got
    assert got[1]["text"] == "t10" and got[1]["d"] == "a" and got[0]["text"] is None
    assert quality.to_message_level(df, "absent", ["k"], ["d"])[1] is df


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (2, 3, None), (2, 4, None)], "m int, k int, d string")
    got = {r["m"]: r["d"] for r in quality.to_message_level(df, "m", ["k"], ["d"])[1].collect()}
    assert got == {1: "a", 2: None}


def test_duplicates_count_nulls_and_blanks_apart(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", ""), ("a", None)], "x string, y string")
    assert quality.duplicate_rows(df).first()[0] == 2


def test_proportional_sizes_hold_beyond_the_absolute_ones(spark):
    rows = [(k, "ab"[k % 3 == 0]) for k in range(900)]
    df = spark.createDataFrame(rows, "k bigint, s string")
    got = splits.split_proportional(df, ["k"], "s", train=50, validation=25, test=25)
    assert Counter(r["split"] for r in got.collect()) == {"train": 450, "validation": 225, "test": 225}
    want = brute_split(rows, 42, {s: [("test", n), ("validation", n), ("train", 2 * n)] for s, n in (("a", 150), ("b", 75))})
    assert {r["k"]: r["split"] for r in got.collect()} == want
