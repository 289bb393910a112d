"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


_SHIPPED: set[str] = set()


#: Rows that go to a Python worker at once; texts are long, and two copies of a batch are held.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make a session ready for the Python tasks: small batches, and the packages' sources on the
    executors (sent once a session)."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "sources.zip")
    with zipfile.ZipFile(path, "w") as sources:
        for package in ("llm", "alertloom"):
            for file in sorted((root / package).rglob("*.py")):
                sources.write(file, file.relative_to(root))
    context.addPyFile(path)


def landed(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it from there.

    Cuts the lineage: lost executors cost a re-read. Later passes read only the columns they use.
    """
    path = noted(scratch_path(df.sparkSession, name))
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Scratch folders since the last `forget_scratch`.
_NOTED: list[str] = []


def noted(path: str) -> str:
    """The path, which `forget_scratch` will remove."""
    _NOTED.append(path)
    return path


def forget_scratch(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Remove the scratch folders noted so far, but for those that hold a file of `keep`.

    For a job of stages: what is read from an earlier stage must have been written by then.
    """
    needed = {urlparse(k).path for k in keep}
    left = [p for p in _NOTED if any(k.startswith(f"{urlparse(p).path}/") for k in needed)]
    for path in set(_NOTED) - set(left):
        _remove(spark, path)
    _NOTED[:] = left


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Spark's setting to remove a query's shuffles when it ends, not when the driver collects its garbage.
_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Landing:
    """Tables that are landed one after another, without their shuffles; `drop` removes those that were replaced."""

    def __init__(self):
        self.held: list[tuple[DataFrame, str]] = []

    def land(self, df: DataFrame, name: str) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(_SHUFFLES, None)
        conf.set(_SHUFFLES, "true")
        try:
            table = landed(df, name)
        finally:
            conf.unset(_SHUFFLES) if before is None else conf.set(_SHUFFLES, before)
        self.held.append((table, _NOTED[-1]))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, path in [x for x in self.held if any(x[0] is t for t in tables)]:
            _remove(table.sparkSession, path)
            _NOTED.remove(path)
        self.held = [x for x in self.held if not any(x[0] is t for t in tables)]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def hash_sample(rows: DataFrame, n: int, total: int, *columns: str) -> DataFrame:
    """At most `n` of `total` rows, those of the smallest hash of `columns` (and then of the smallest `columns`).

    A cut on the hash comes before the sort, so that all tasks together offer the driver little more than `n`
    rows, not each of them. `columns` should tell the rows apart.
    """
    value = F.xxhash64(*columns)
    if total > 2 * n:
        # 25 % more than n are expected below the cut; fewer than n would need many standard deviations for n >= 500.
        rows = rows.where(value <= F.lit(int((1.25 * n / total) * (1 << 64)) - (1 << 63)))
    return rows.orderBy(value, *columns).limit(n)


def range_of(spark: SparkSession, key: Column, bounds: list) -> Column:
    """Number of sorted `bounds` at or before the key (strings of ASCII or integers, not null), by binary search."""
    if not bounds:
        return F.lit(0)
    ship(spark)
    sent = spark.sparkContext.broadcast(np.array([b.encode() for b in bounds] if isinstance(bounds[0], str) else bounds))

    @F.pandas_udf("int")
    def search(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy()
        values = np.array([v.encode() for v in values]) if sent.value.dtype.kind == "S" else values
        return pd.Series(np.searchsorted(sent.value, values, "right").astype(np.int32))

    return search(key)


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores in front until no column of `df` has the name."""
    names = {c.lower() for c in df.columns}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted
