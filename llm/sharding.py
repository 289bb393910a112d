"""Range sharding by sampled splitters, near equal in bytes.

A size-weighted sample of keys gives quantile boundaries; ranges that turn out overfull are sampled
again and subdivided. Ranges grow in number with the rows and only deal out the work: shard borders come from exact running sizes
inside each range plus the ranges' exact starts.

Edge cases: a null text weighs the row overhead and has checksum 0; rows with equal keys stay in key
order; an empty table gives no rows; fewer records than shards leave shards empty; a record larger
than a shard fills one by itself.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.ranking import with_row_id
from llm.common import free_name, landed, range_of

#: Ranges for each shard at least, and rows of a range about; keys drawn for each range, and in all at least. The driver holds
#: the keys: some 30 for a million rows.
RANGES_PER_SHARD = 8
RANGE_ROWS = 1 << 20
KEYS_PER_RANGE = 24
SAMPLE = 8192
#: A range is overfull beyond this many times the mean.
OVERFULL = 2.0
ROUNDS = 4


def _weighted_keys(rows: DataFrame, n: int, total: int, seed: int) -> list[str]:
    """At most `n` keys of rows of `total` bytes, drawn without replacement in proportion to size."""
    u = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = rows.select("key", (-F.log(u) / F.col("size")).alias("e"))
    # All tasks together offer the driver little more than n rows: at most total * cut are expected below a cut.
    drawn = drawn.where(F.col("e") <= 1.25 * n / max(1, total))
    return sorted(r.key for r in drawn.orderBy("e", "key").limit(n).collect())


def _quantiles(keys: list[str], parts: int) -> list[str]:
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _snap(bounds: list[str], least: int) -> list[str]:
    """Cut before a whole group, unless at least `least` boundaries show that the group is large."""
    groups = [b.split("/")[0] for b in bounds]
    several = Counter(groups)
    return sorted({b if several[g] >= least else g for b, g in zip(bounds, groups, strict=True)})


def _splitters(rows: DataFrame, ranges: int, total: int, limit: int) -> tuple[list[str], dict[int, int]]:
    """Boundaries and the exact bytes of each range. Groups of up to `limit` bytes lie in one range (but for bad luck
    of the sample, by a factor of two)."""
    spark, sample, mean = rows.sparkSession, max(SAMPLE, KEYS_PER_RANGE * ranges), total / max(1, ranges)
    least = max(2, -(-2 * limit // max(1, int(mean))) + 1)
    bounds = _snap(_quantiles(_weighted_keys(rows, sample, total, 1), ranges), least)
    for round_no in range(ROUNDS):
        ranged = rows.withColumn("range", range_of(spark, F.col("key"), bounds))
        held = {r.range: r.bytes for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
        full = [r for r, b in held.items() if b > OVERFULL * mean]
        if not full or round_no == ROUNDS - 1:
            break
        over = sum(held[r] for r in full)
        # One row for each overfull range.
        inside = ranged.join(F.broadcast(spark.createDataFrame([(r,) for r in full], "range int")), "range", "left_semi")
        keys = _weighted_keys(inside, sample, over, 2 + round_no)
        more = sorted({*bounds, *_snap(_quantiles(keys, max(2, round(over / mean))), least)})
        if more == bounds:
            break
        bounds = more
    return bounds, held


def shard_records(rows: DataFrame, shards: int) -> DataFrame:
    """Columns id, size, group_key -> the same plus shard and slot.

    Rows of one `group_key` share a shard as long as the group is no larger than the largest record
    or a hundredth of a shard; larger groups are split between records.
    """
    key = F.concat(
        F.lpad(F.hex("group_key"), 16, "0"), F.lit("/"), F.lpad(F.hex(F.coalesce(F.col("id"), F.lit(-1))), 16, "0")
    )
    rows = landed(rows.withColumn("key", key), "shard-keys")
    total, largest, count = rows.agg(F.sum("size"), F.max("size"), F.count("*")).first()
    spark, total = rows.sparkSession, total or 1
    limit = max(largest or 0, total // shards // 100)
    bounds, held = _splitters(rows, max(shards * RANGES_PER_SHARD, count // RANGE_ROWS), total, limit)

    starts, before = [], 0
    for r in sorted(held):
        starts.append((r, before))
        before += held[r]
    # One row for each range.
    start_of = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "range int, range_start long"))

    in_range = Window.partitionBy("range").orderBy("key")
    group = Window.partitionBy("range", "group_key")
    begin = F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        rows.withColumn("range", range_of(spark, F.col("key"), bounds))
        .join(start_of, "range")
        .withColumn("begin", F.col("range_start") + F.coalesce(begin, F.lit(0)))
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_begin", F.min("begin").over(group))
    )
    middle = F.when(
        F.col("group_bytes") <= limit, 2 * F.col("group_begin") + F.col("group_bytes")
    ).otherwise(2 * F.col("begin") + F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(2.0 * total)).cast("int"))
    placed = landed(placed.withColumn("shard", shard).drop("begin", "group_begin", "group_bytes", "range_start"), "shards")

    # Rows of a shard in each of its ranges: at most ranges + shards rows.
    counts = placed.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("range", "shard").orderBy("key"))
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(offsets), ["range", "shard"])
        .withColumn("slot", F.col("ahead") + F.col("within") - 1)
        .drop("key", "within", "ahead", "range")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole records into one folder for each shard (shard=0, ...), in slot order.

    `assigned` comes from the very rows of `docs`, so both have the same ids equally often. Both are numbered
    in the order of their ids, by range sorts that split an id of many rows, and meet by number: rows with a null or
    repeated id are written once each. Columns of `docs` called shard or slot keep their values under a free name
    (underscores in front).
    """
    for taken in ("shard", "slot"):
        for c in [c for c in docs.columns if c.lower() == taken]:
            docs = docs.withColumnRenamed(c, free_name(docs, taken))
    number = free_name(docs, "number")
    placed = with_row_id(assigned.select("id", "shard", "slot"), ["id", "shard", "slot"], number).drop("id")
    rows = with_row_id(docs, [F.col(id_col), F.monotonically_increasing_id()], number)
    joined = rows.join(placed, number).drop(number)
    joined.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
