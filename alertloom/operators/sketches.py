"""Mergeable quantile sketches of columns: kept with a model, merged with those of later batches.

A sketch answers any quantile within a small rank error (about 2.3 / k of the rows); up to k values it is exact.
One batch adds a few KB per column, whatever its size, so fences can follow the data without reading old rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.clean import Fences, present

#: Accuracy of a sketch; its size grows in proportion.
SKETCH_K = 2000


def column_sketches(df: DataFrame, columns: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """(column, sketch, n, low, high) per numeric column, in one aggregation; nulls are left out."""
    columns = present(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, sketch binary, n bigint, low double, high double")

    def about(c: str) -> Column:
        value = F.col(c).cast("double")
        sketch = F.kll_sketch_agg_double(value, F.lit(k))
        parts = (F.lit(c).alias("column"), sketch.alias("sketch"), F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        return F.struct(*parts).alias(c)

    row = df.agg(*[about(c) for c in columns])
    return row.select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))


def merge_sketches(tables: Sequence[DataFrame]) -> DataFrame:
    """The sketches of all rows of several batches."""
    return reduce(DataFrame.unionByName, tables).groupBy("column").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


def sketch_quantiles(sketches: DataFrame, probs: Mapping[str, Sequence[float]]) -> dict[str, dict[float, float | None]]:
    """Quantiles of each column that is asked for; null where it has no values."""
    every = sorted({p for ps in probs.values() for p in ps})
    if not every:
        return {}
    found = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))) for p in every]
    # One row per column.
    rows = sketches.where(F.col("column").isin(list(probs))).select("column", F.array(*found).alias("q")).collect()
    at = {r["column"]: dict(zip(every, r["q"], strict=True)) for r in rows}
    return {c: {p: at[c][p] for p in ps} for c, ps in probs.items() if c in at}


def fences_of(sketches: DataFrame, k: float = 1.5) -> Fences:
    """Outlier fences per column; None where the spread is zero or there are no values."""
    ends = {r["column"]: (r["low"], r["high"]) for r in sketches.select("column", "low", "high").collect()}
    fences: dict[str, tuple[float, float] | None] = {}
    for c, q in sketch_quantiles(sketches, {c: (0.25, 0.75) for c in ends}).items():
        low, high = q[0.25], q[0.75]
        spread = None if low is None or ends[c][0] == ends[c][1] else high - low
        fences[c] = (low - k * spread, high + k * spread) if spread is not None and spread > 0 else None
    return fences


def thresholds_of(sketches: DataFrame, flags: Mapping[str, tuple[str, float]]) -> dict[str, float | None]:
    """Bounds of the high-value flags whose column was sketched."""
    probs: dict[str, list[float]] = {}
    for column, prob in flags.values():
        probs.setdefault(column, []).append(prob)
    at = sketch_quantiles(sketches, probs)
    return {name: at[c][p] for name, (c, p) in flags.items() if c in at}
