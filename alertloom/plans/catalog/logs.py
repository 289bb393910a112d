"""Queries for model and run logs; events stand for log records."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.plans.alerts import table
from alertloom.plans.catalog import sql
from alertloom.plans.catalog.registry import query, rounded
from alertloom.session import scratch_path
from alertloom.sources import runlog

# user -> training id; a value is taken as reported only for some event types.
_STATUS = (
    "SELECT user_id AS training_id, ts AS updated_at, event_id, event_type AS status, "
    "CASE WHEN event_id % 3 = 0 THEN value END AS progress FROM events"
)


def _status(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("training_id"), F.col("ts").alias("updated_at"), "event_id",
        F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("progress"),
    )


@query("R1", "SELECT event_type AS status, count(*) AS runs, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def log_runs(spark, sf_dir):
    path = scratch_path(spark, "training_runs")
    runs = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("training_id"), F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("created_at"),
    )
    runlog.append(runs.where("status = 'error'"), path)
    runlog.append(runs.where("status <> 'error'"), path)
    stored = runlog.read_log(spark, path)
    return stored.groupBy("status").agg(F.count("*").alias("runs"), F.count_distinct("user_id").alias("users"))


@query("R2", sql.with_ctes(
    [("s", _STATUS)],
    "SELECT training_id, arg_max(status, ROW(updated_at, event_id)) AS status, "
    f"{sql.fixed('arg_max(progress, ROW(updated_at, event_id)) FILTER (WHERE progress IS NOT NULL)')} AS progress, "
    "strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM s GROUP BY 1",
))
def upsert_status(spark, sf_dir):
    merged = runlog.merge_status(_status(spark, sf_dir), "training_id", ["updated_at", "event_id"], ["status", "progress"])
    return rounded(merged.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")))


@query("R2", sql.with_ctes(
    [
        ("s", _STATUS),
        ("old", "SELECT training_id, arg_max(status, ROW(updated_at, event_id)) AS status, arg_max(progress, ROW(updated_at, event_id)) FILTER (WHERE progress IS NOT NULL) AS progress FROM s WHERE status <> 'error' GROUP BY 1"),
        ("new", "SELECT training_id, arg_max(status, ROW(updated_at, event_id)) AS status, max(updated_at) AS at FROM s WHERE status = 'error' GROUP BY 1"),
    ],
    f"SELECT training_id, coalesce(new.status, old.status) AS status, {sql.fixed('old.progress')} AS progress FROM old FULL JOIN new USING (training_id)",
))
def upsert_fields(spark, sf_dir):
    events = _status(spark, sf_dir)
    order = ["updated_at", "event_id"]
    current = runlog.merge_status(events.where("status <> 'error'"), "training_id", order, ["status", "progress"])
    updates = runlog.merge_status(events.where("status = 'error'"), "training_id", order, ["status"])
    # An update is newer than what it updates, and leaves what it does not name.
    updates = updates.withColumn("progress", F.lit(None).cast("double")).withColumn(
        "updated_at", F.col("updated_at") + F.expr("INTERVAL 1000 DAYS")
    )
    return rounded(runlog.upsert_status(current, updates, "training_id", ["status", "progress"]).drop("updated_at"))


@query("R3", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 8 AND event_type = 'error'")
def find_records(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return runlog.find(events, limit=None, user_id=8, event_type="error")


@query("R4", "SELECT CAST(max(p_size) FILTER (WHERE p_partkey % 7 <> 0) + 1 AS BIGINT) AS next_version, "
             "CAST(max(p_size) FILTER (WHERE p_partkey % 7 <> 0) AS BIGINT) AS latest_version, count(*) AS models FROM part")
def version_summary(spark, sf_dir):
    names = F.when(F.col("p_partkey") % 7 == 0, "draft").otherwise(F.concat(F.lit("v"), F.col("p_size").cast("string")))
    return runlog.version_summary(table(spark, sf_dir, "part").select(names.alias("version")))


_ARCHIVED = (
    "SELECT p_partkey AS model_id, p_size AS model_version, CASE WHEN {0} AND p_brand <> 'Brand#2' THEN 'archived' "
    "WHEN p_brand = 'Brand#2' THEN 'draft' ELSE 'active' END AS status, CASE WHEN {0} AND p_brand <> 'Brand#2' "
    "THEN '2024-01-01' END AS archived_at FROM part"
)


def _models(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("model_id"), F.col("p_size").alias("model_version"),
        F.when(F.col("p_brand") == "Brand#2", "draft").otherwise("active").alias("status"),
    )


@query("R5", _ARCHIVED.format("p_size < 20"))
def archive_all_models(spark, sf_dir):
    return runlog.archive_models(_models(spark, sf_dir), 20, F.lit("2024-01-01"), "all")


@query("R5", _ARCHIVED.format("p_size = 19"))
def archive_previous_model(spark, sf_dir):
    return runlog.archive_models(_models(spark, sf_dir), 20, F.lit("2024-01-01"), "previous")


_SECONDS = "(CASE WHEN event_id % 10 = 0 THEN 0 ELSE value END)"


@query("R6", "SELECT event_id, round(rows_n / d, 3) + 0.0 AS rows_per_second, round(d, 3) + 0.0 AS duration FROM ("
             f"SELECT event_id, user_id AS rows_n, round(abs({_SECONDS}), 3) AS d FROM events) WHERE d > 0 "
             f"UNION ALL SELECT event_id, 0.0, 0.0 FROM events WHERE round(abs({_SECONDS}), 3) = 0")
def run_throughput(spark, sf_dir):
    seconds = F.round(F.abs(F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value"))), 3)
    runs = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("record_count"), F.timestamp_micros(F.lit(0)).alias("started_at"),
        F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")).alias("ended_at"),
    )
    made = runlog.run_throughput(runs)
    return rounded(made.select("event_id", "rows_per_second", "duration"), 3)


@query("U1", sql.with_ctes(
    [("listed", "SELECT p_partkey AS model_id, CASE WHEN p_size >= 20 THEN 'active' ELSE 'archived' END AS status FROM part")],
    "SELECT model_id, status FROM listed",
))
def union_models(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), "p_size")
    return runlog.union_models(
        parts.where("p_size >= 20").drop("p_size"), parts.where("p_size < 20").drop("p_size")
    )


@query("U1", "SELECT CASE WHEN p_size >= 20 THEN 'active' ELSE 'archived' END AS status, count(*) AS n FROM part GROUP BY 1 "
             "UNION ALL SELECT 'total', count(*) FROM part")
def model_totals(spark, sf_dir):
    return runlog.model_totals(union_models(spark, sf_dir))
