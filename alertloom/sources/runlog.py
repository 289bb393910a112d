"""Model and run logs as append-only tables, and the queries on them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.number import ratio

SCHEMAS = {
    "models": (
        "model_id string, user_id string, model_name string, model_version int, tag string, "
        "level string, status string, deployed boolean, notes string, model_type string, "
        "framework string, model_path string, feature_list array<string>, "
        "performance_metrics map<string,double>, created_at timestamp, updated_at timestamp"
    ),
    "training_runs": (
        "training_id string, model_id string, user_id string, level string, status string, "
        "datasets map<string,string>, data_size map<string,bigint>, metrics map<string,double>, "
        "started_at timestamp, ended_at timestamp, duration double, created_at timestamp, "
        "updated_at timestamp"
    ),
    "validation_runs": (
        "validation_id string, training_id string, model_id string, user_id string, level string, "
        "status string, datasets map<string,string>, data_size map<string,bigint>, "
        "metrics map<string,double>, started_at timestamp, ended_at timestamp, "
        "created_at timestamp, updated_at timestamp"
    ),
    "prediction_runs": (
        "prediction_id string, model_id string, training_id string, user_id string, level string, "
        "status string, input_data struct<source_type:string,location:string,record_count:bigint>, "
        "predictions struct<total:bigint,hit:bigint,message:bigint>, "
        "performance struct<processing_time_sec:double,predictions_per_second:double>, "
        "started_at timestamp, ended_at timestamp, created_at timestamp"
    ),
    "system_status": (
        "training_id string, user_id string, status string, is_training boolean, "
        "progress_percentage double, metrics map<string,double>, start_time timestamp, "
        "end_time timestamp, updated_at timestamp"
    ),
}


def append(records: DataFrame, path: str) -> None:
    """Append log records; `created_at` is filled with the current time where absent."""
    if "created_at" not in records.columns:
        records = records.withColumn("created_at", F.current_timestamp())
    records.write.mode("append").parquet(path)


def log_record(spark: SparkSession, kind: str, path: str, **fields) -> None:
    """Append one record of a known kind; fields not given are null."""
    schema = SCHEMAS[kind]
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    unknown = set(fields) - set(names)
    if unknown:
        raise ValueError(f"unknown {kind} fields: {sorted(unknown)}")
    if "created_at" in names:
        fields.setdefault("created_at", datetime.now(timezone.utc))
    append(spark.createDataFrame([tuple(fields.get(n) for n in names)], schema), path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find(log: DataFrame, limit: int | None = 1, **fields) -> DataFrame:
    """Records whose fields equal the given values."""
    condition = F.lit(True)
    for name, value in fields.items():
        condition = condition & (F.col(name) == F.lit(value))
    found = log.where(condition)
    return found if limit is None else found.limit(limit)


def merge_status(events: DataFrame, key: str, when: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Current state per key: each field's newest non-null value, and the newest time.

    `when` orders the events; one aggregation, reduced before the shuffle.
    """
    place = F.struct(*when)
    newest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields]
    return events.groupBy(key).agg(*newest, F.max(when[0]).alias("updated_at"))


def upsert_status(
    current: DataFrame, updates: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """Current table with the updates merged in: given fields win, null ones keep their value."""
    both = current.select(key, "updated_at", *fields, F.lit(0).alias("_new")).unionByName(
        updates.select(key, "updated_at", *fields, F.lit(1).alias("_new"))
    )
    return merge_status(both, key, ["updated_at", "_new"], fields)


def version_number(name: str | Column) -> Column:
    """Number of a `v<number>` name, else null."""
    return F.regexp_extract(name, r"^v([0-9]+)$", 1).try_cast("bigint")


def version_summary(models: DataFrame, name: str = "version") -> DataFrame:
    """(next_version, latest_version, models) of a model log with `v<n>` names."""
    number = version_number(F.col(name))
    return models.agg(
        (F.coalesce(F.max(number), F.lit(0).cast("bigint")) + 1).alias("next_version"),
        F.max(number).alias("latest_version"),
        F.count("*").alias("models"),
    )


def archive_models(
    models: DataFrame, current_version: int, at: Column, mode: str = "previous",
    version: str = "model_version", status: str = "status",
) -> DataFrame:
    """Mark earlier active versions archived: all of them, or just the one before."""
    if mode == "all":
        earlier = F.col(version) < F.lit(current_version)
    elif mode == "previous":
        earlier = F.col(version) == F.lit(current_version - 1)
    else:
        raise ValueError(f"mode must be all or previous, not {mode!r}")
    hit = earlier & (F.col(status) == "active")
    archived_at = F.col("archived_at") if "archived_at" in models.columns else F.lit(None)
    return models.withColumns(
        {
            status: F.when(hit, F.lit("archived")).otherwise(F.col(status)),
            "archived_at": F.when(hit, at).otherwise(archived_at),
        }
    )


def union_models(active: DataFrame, archived: DataFrame) -> DataFrame:
    """Active and archived models in one list, told apart by status."""
    return active.withColumn("status", F.lit("active")).unionByName(
        archived.withColumn("status", F.lit("archived"))
    )


def model_totals(listed: DataFrame) -> DataFrame:
    """(status, n) of a model list, with the total."""
    counts = listed.groupBy("status").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("status"), "n")
    return counts.unionByName(total)


def run_throughput(
    runs: DataFrame, start: str = "started_at", end: str = "ended_at", rows: str = "record_count"
) -> DataFrame:
    """Add duration in seconds and rows per second (0 for a duration of 0)."""
    seconds = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6
    return runs.withColumn("duration", seconds).withColumn(
        "rows_per_second", ratio(F.col(rows), F.col("duration"))
    )


def exists(spark: SparkSession, path: str) -> bool:
    """True if something was logged at `path`; other failures to read are raised."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
