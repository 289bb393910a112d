"""The most frequent values of a column, exactly, without a shuffle of every distinct value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.session import broadcast_if_small, cut_lineage

#: Slots of the value's hash that are counted for each target; and values that the sketch keeps for each one wanted.
SLOTS, TRACKED = 1 << 16, 16
#: Spark's bound on the values of a sketch.
MOST_TRACKED = 1_000_000


def most_frequent(rows: DataFrame, n: int) -> DataFrame:
    """(target, value) rows -> (target, value, n): the `n` most frequent values of each target (ties: smaller value first).

    A mergeable sketch proposes candidates, which are counted exactly. What else could belong to the result is found by
    exact counts of hash slots: a slot whose other rows are fewer than the n-th best candidate's holds no such value. Only
    values of the remaining slots are counted one by one. Where no values stand out, that is all of them.
    Null values take no part.
    """
    slot = F.pmod(F.xxhash64("value"), F.lit(SLOTS)).cast("int")
    rows = rows.where(F.col("value").isNotNull()).select("target", "value", slot.alias("slot"))
    proposed, tracked = min(2 * n, MOST_TRACKED), min(TRACKED * n, MOST_TRACKED)
    sketch = F.expr(f"approx_top_k(value, {proposed}, {max(proposed, tracked)})")
    named = rows.groupBy("target").agg(sketch.alias("top")).select("target", F.explode("top.item").alias("value"))
    named = broadcast_if_small(cut_lineage(named))
    counted = rows.join(named, ["target", "value"], "left_semi").groupBy("target", "slot", "value").agg(F.count("*").alias("n"))
    counted = cut_lineage(counted)
    # At most 2 n rows for each target.
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("n"), "value"))
    border = counted.withColumn("place", place).where(F.col("place") == n).select("target", F.col("n").alias("least"))
    inside = counted.groupBy("target", "slot").agg(F.sum("n").alias("inside"))
    slots = rows.groupBy("target", "slot").agg(F.count("*").alias("all")).join(inside, ["target", "slot"], "left").join(border, "target", "left")
    other = F.col("all") - F.coalesce("inside", F.lit(0))
    # At most SLOTS rows for each target.
    open_ = cut_lineage(slots.where((other > 0) & (other >= F.coalesce("least", F.lit(1)))).select("target", "slot"))
    rest = rows.join(broadcast_if_small(open_), ["target", "slot"], "left_semi").join(named, ["target", "value"], "left_anti")
    rest = rest.groupBy("target", "value").agg(F.count("*").alias("n"))
    both = counted.select("target", "value", "n").unionByName(rest)
    return both.withColumn("place", place).where(F.col("place") <= n).drop("place")
