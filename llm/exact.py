"""Exact deduplication as a stateful stream.

A keyed state without expiry, kept on disk by the RocksDB state store, holds for each digest the
stable identifier of the row that stays (the largest id), the locator of its content and how many
rows there were. Every row that meets an occupied digest is compared with the kept row's full bytes.

Only DataFrame operations are used: no Python runs on the executors.

Edge cases: null text counts as empty text; empty texts are copies of each other; rows with the same
id and text count each; an empty table gives no rows; a null id is smaller than any other id.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import scratch_path
from llm.common import ascii_lower, landed, noted

#: Memory for all RocksDB instances of an executor; beyond it they write to disk.
STATE_MB = 64


@contextmanager
def _disk_state(spark: SparkSession):
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
        # Many small stores: no file space is reserved ahead, and a batch uploads its changes only.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the normalised text, and its length in bytes."""
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(
        F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("bytes")
    )


def digest_state(rows: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Run the landed digest rows through the stateful stream; one row per digest.

    Each micro-batch reduces its rows by digest before the shuffle, so a text that makes up a third
    of all rows reaches the state as one row for each task.
    """
    spark = rows.sparkSession
    source = rows.inputFiles()
    if not source:
        return rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    folder = source[0].rsplit("/", 1)[0]
    reader = spark.readStream.schema(rows.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    state = (
        reader.parquet(folder)
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    out = noted(scratch_path(spark, "digest-state"))

    def emit(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _disk_state(spark):
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", noted(scratch_path(spark, "digest-stream")))
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        query.awaitTermination()
    # Each batch emits the digests it touched, with their state so far; the last one holds.
    emitted = spark.read.schema(state.schema).parquet(f"{out}/batch=*")
    return emitted.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_trigger: int | None = None,
    batches: int | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The digests are streamed `files_per_trigger` files at a time, or in about `batches` micro-batches
    of equally many files, or all in one; later batches meet the digests that the state keeps.

    Rows whose bytes differ from the kept row's in spite of an equal digest are grouped again by
    their full text.
    """
    rows = landed(digest_rows(docs, id_col, text_col), "digests")
    if batches and not files_per_trigger:
        files_per_trigger = max(1, -(-len(rows.inputFiles()) // batches))
    state = landed(digest_state(rows, files_per_trigger), "digest-groups")
    marked = rows.join(state, "digest", "left")

    # Rows of digests met more than once are compared with the kept row's bytes, which are read
    # again through the locator in the state (the id).
    hits = marked.where("group_size > 1").select("id", "digest", "keep_id")
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    source = docs.select(F.col(id_col).alias("id"), text.alias("full"))
    hit_text = landed(hits.select("id", "digest", "keep_id").distinct().join(source, "id"), "hit-texts")
    # Landed, so that the join below is between plain shuffles, which are split where a digest is hot.
    kept_text = landed(
        hit_text.where("id = keep_id")
        .where(F.sha2("full", 256) == F.col("digest"))
        .groupBy("digest")
        .agg(F.min("full").alias("kept_full")),
        "kept-texts",
    )
    differing = landed(
        hit_text.where(F.sha2("full", 256) == F.col("digest"))
        .join(kept_text, "digest")
        .where("full <> kept_full")
        .select("id", "digest", "full"),
        "digest-collisions",
    )
    own = differing.groupBy("digest", "full").agg(
        F.max("id").alias("own_keep"), F.countDistinct("id").alias("own_size")
    )
    again = differing.join(own, ["digest", "full"]).select("id", "digest", "own_keep", "own_size")
    lost = own.groupBy("digest").agg(F.sum("own_size").alias("lost"))
    out = marked.join(again, ["id", "digest"], "left").join(lost, "digest", "left")
    keep = F.coalesce("own_keep", "keep_id")
    return out.select(
        "id",
        keep.alias("keep_id"),
        F.coalesce("own_size", F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        F.coalesce(F.col("id") == keep, F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
