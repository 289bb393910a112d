"""Session set-up, shared scratch space, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that may be sent to every executor, or ranked in one task.
SMALL_TABLE_ROWS = 200_000
SMALL_TABLE_BYTES = 64 << 20


def local_session(app: str = "alertloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("ALERTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_sources(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once a session; its Arrow functions run there."""
    context = spark.sparkContext
    if context.master.startswith("local[") or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "package.zip")
    with zipfile.ZipFile(path, "w") as sources:
        for file in sorted(package.rglob("*.py")):
            sources.write(file, file.relative_to(package.parent))
    context.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder once and read it from there afterwards.

    Used where a result is small and read many times, or where its physical row
    order must not change on recomputation. Survives the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it from there.

    For wide tables that are read several times: later passes read the columns they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that is read in fewer splits than there are cores over all of them.

    For row-local work that costs far more than moving the rows; tables of many splits stay put.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_small(table: DataFrame, rows: int = SMALL_TABLE_ROWS, size: int = SMALL_TABLE_BYTES) -> bool:
    """True if `table` has at most `rows` rows and its strings at most `size` bytes; reads no more than `rows + 1` rows."""
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in table.schema if f.dataType.typeName() in ("string", "binary")]
    held = reduce(Column.__add__, texts, F.lit(0).cast("long"))
    found, bytes_ = table.limit(rows + 1).agg(F.count("*"), F.sum(held)).first()
    return found <= rows and (bytes_ or 0) <= size


def broadcast_if_small(table: DataFrame, rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Broadcast hint for a materialised table of proven size, else the table as it is.

    Without the hint Spark plans a shuffled join, which adaptive execution splits
    where a key is skewed.
    """
    return F.broadcast(table) if is_small(table, rows) else table
