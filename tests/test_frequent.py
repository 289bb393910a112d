from collections import Counter

import pytest
from pyspark.sql import functions as F

from alertloom.operators import frequent, labels
from alertloom.session import is_small


def brute(rows, n):
    out = []
    for target in {t for t, _ in rows}:
        counts = Counter(v for t, v in rows if t == target and v is not None)
        out += [(target, v, c) for v, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]]
    return sorted(out)


# Values that stand out, ties at the border, and none that stand out; one value with most rows.
ROWS = [("a", f"v{i * i % 7001 % (1 + i % 211)}") for i in range(9000)] + [("a", "hot")] * 6000
ROWS += [("b", f"once {i}") for i in range(700)] + [("c", None), ("c", "only"), ("d", None)] + [("e", f"tie {i % 40}") for i in range(400)]


@pytest.mark.parametrize("n, slots, tracked", [(10, 1 << 16, 16), (25, 7, 2), (1, 1, 2)])
def test_equals_full_counts(spark, monkeypatch, n, slots, tracked):
    monkeypatch.setattr(frequent, "SLOTS", slots)
    monkeypatch.setattr(frequent, "TRACKED", tracked)
    df = spark.createDataFrame(ROWS, "target string, value string").repartition(5)
    assert sorted(map(tuple, frequent.most_frequent(df, n).collect())) == brute(ROWS, n)


def test_values_the_sketch_misses_are_found(spark, monkeypatch):
    # A sketch that proposes the wrong values only costs a recount.
    monkeypatch.setattr(frequent.F, "expr", lambda _: F.struct(F.array(F.min("value").alias("x")).alias("item")))
    df = spark.createDataFrame(ROWS, "target string, value string")
    assert sorted(map(tuple, frequent.most_frequent(df, 10).collect())) == brute(ROWS, 10)


def test_empty_table(spark):
    assert frequent.most_frequent(spark.createDataFrame([], "target string, value string"), 3).collect() == []
    assert labels.reduce_cardinality(spark.createDataFrame([], "v string"), "v", 2).collect() == []


def test_small_tables_are_small_in_bytes_too(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("x"))
    assert is_small(wide) and not is_small(wide, size=9999) and not is_small(wide, rows=9)
