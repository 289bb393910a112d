"""Row numbers, per-group positions and newest-per-key, without one-task windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.session import broadcast_if_small, cut_lineage, is_small, stored

_POSITION = "_position"
_PART = "_part"


def with_row_id(df: DataFrame, order: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """0..n-1 in the given order; `order` must be a total order over the rows.

    The rows are range-sorted once and written. Their place is then the start of
    their partition plus their offset in it, so no task sees more than one partition.
    The written copy keeps the numbering fixed when tasks are recomputed.
    """
    # monotonically_increasing_id is (partition << 33) + offset within the partition.
    rows = stored(df.orderBy(*order).withColumn(_POSITION, F.monotonically_increasing_id()))
    rows = rows.withColumn(_PART, F.shiftright(_POSITION, 33))
    sizes = rows.groupBy(_PART).agg(F.count("*").alias("_n"))
    # One row per partition of the sort, so both the window and the broadcast stay small.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(_PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    offset = F.col(_POSITION).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.join(F.broadcast(starts), _PART)
        .withColumn(name, (F.col("_start") + offset).cast("bigint"))
        .drop(_PART, _POSITION, "_start")
    )


def index_within(
    table: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """0-based position inside each group of an aggregated table, written once.

    A table of proven small size is ranked by a window. A larger one is sorted
    as a whole, and each group's first row number is subtracted.
    """
    table = cut_lineage(table)
    if is_small(table):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
        return cut_lineage(table.withColumn(name, place.cast("bigint")))
    numbered = with_row_id(table, [*group, *order], "_global")
    if not group:
        return numbered.withColumnRenamed("_global", name)
    firsts = numbered.groupBy(*group).agg(F.min("_global").alias("_first"))
    matches = [F.col(f"n.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    condition = matches[0]
    for match in matches[1:]:
        condition = condition & match
    return (
        numbered.alias("n")
        .join(broadcast_if_small(cut_lineage(firsts)).alias("f"), condition)
        .select(
            *[F.col(f"n.{c}") for c in table.columns],
            (F.col("n._global") - F.col("f._first")).alias(name),
        )
    )


def head(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First `n` rows in the given order (a distributed top-k)."""
    return df.orderBy(*order).limit(n)


def latest_per_key(df: DataFrame, key: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The newest row per key; later columns of `newest` break ties.

    An aggregation, so that a hot key is reduced before the shuffle.
    """
    others = [c for c in df.columns if c not in key]
    picked = F.max_by(F.struct(*others), F.struct(*newest)).alias("_row")
    return df.groupBy(*key).agg(picked).select(*key, "_row.*").select(*df.columns)


def page(
    df: DataFrame, newest: Sequence[Column], condition: Column | None = None,
    skip: int = 0, limit: int = 10,
) -> DataFrame:
    """Filter, sort newest first, skip, limit."""
    rows = df if condition is None else df.where(condition)
    return rows.orderBy(*newest).offset(skip).limit(limit)
