import json

import pytest
from pyspark.sql import functions as F

from alertloom.operators import ranking
from alertloom.session import scratch_path
from alertloom.sources import files, nested, runlog, texts


def test_csv_round_trip(spark):
    rows = [("1", 'say "hi"', "a\nb, c"), ("2", "NULL", " x "), ("3", "n/a", "")]
    df = spark.createDataFrame(rows, "hit__hit_id string, hit__tag string, hit__matching_text string")
    path = scratch_path(spark, "csv")
    files.write_alerts_csv(df, path)
    assert spark.read.text(path).where("value LIKE 'hit.hit_id,%'").count() >= 1
    back = files.read_alerts_csv(spark, path)
    assert back.columns == df.columns
    assert [tuple(r) for r in back.orderBy("hit__hit_id").collect()] == [("1", 'say "hi"', "a\nb, c"), ("2", None, " x "), ("3", None, None)]


def test_splits_are_written_apart(spark):
    path = scratch_path(spark, "splits")
    df = spark.range(10).select("id", F.when(F.col("id") < 7, "train").when(F.col("id") < 9, "test").alias("split"))
    files.write_splits(df, path)
    assert files.read_split(spark, path, "train").count() == 7 and files.read_split(spark, path, "test").columns == ["id"]


def test_nested_alerts(spark):
    alert = {
        "message_id": "m1",
        "message": {"MT103": {"country": "FR", "synonyms": {"city": ["a", "b"]}}, "MT202": {"amount": 2.5, "beneficiary_institution": {"name": "n", "address": {"city": "c"}}}},
        "blocking_hits": [{"hit_id": "h1", "watchlist_text": ["x", "y"]}, {"hit_id": "h2"}],
        "message_decision": {"options": ["o1", "o2"], "last_action": "go"},
    }
    raw = spark.createDataFrame([(json.dumps(alert),), (json.dumps({"message_id": "m2", "blocking_hits": []}),)], "value string")
    flat = nested.flatten_alerts(nested.parse_alerts(raw))
    got = {(r["message_id"], r["hit__hit_id"]): r for r in flat.collect()}
    assert set(got) == {("m1", "h1"), ("m1", "h2"), ("m2", None)}
    row = got[("m1", "h1")]
    assert (row["hit__watchlist_text"], row["mt103__synonyms__city"], row["mt103__synonyms__name"]) == ("x y", "a b", None)
    assert (row["mt202__beneficiary_institution__address__city"], row["decision__options"]) == ("c", "o1 o2")


def test_text_rows_have_all_features(spark):
    made = texts.texts_to_alerts(spark.createDataFrame([(1, "t")], "k int, t string"), "t", ["k"])
    assert len(made.columns) == 69
    row = made.first()
    assert (row["hit__matching_text"], row["hit__score"], row["mt202__mt_type"], row["decision__options"]) == ("t", 85, None, "")


def test_run_log(spark):
    path = scratch_path(spark, "log")
    for i in range(3):
        runlog.log_record(spark, "models", path, model_id=f"m{i}", model_version=i, status="active", level="both")
    log = runlog.read_log(spark, path)
    assert log.count() == 3 and log.where("created_at IS NULL").count() == 0
    assert runlog.find(log, model_id="m1").first()["model_version"] == 1
    with pytest.raises(ValueError):
        runlog.log_record(spark, "models", path, colour="red")
    archived = runlog.archive_models(log, 2, F.current_timestamp(), "all")
    assert {r["model_id"]: r["status"] for r in archived.collect()} == {"m0": "archived", "m1": "archived", "m2": "active"}
    with pytest.raises(ValueError):
        runlog.archive_models(log, 2, F.current_timestamp(), "some")


def test_upsert_keeps_what_is_not_named(spark):
    schema = "id string, updated_at timestamp, a string, b double"
    t = lambda d: F.to_timestamp(F.lit(d))
    old = spark.createDataFrame([("x", None, "run", 0.5), ("y", None, "run", 0.1)], schema).withColumn("updated_at", t("2024-01-01"))
    new = spark.createDataFrame([("x", None, "done", None), ("z", None, "run", 0.0)], schema).withColumn("updated_at", t("2024-01-01"))
    got = {r["id"]: (r["a"], r["b"]) for r in runlog.upsert_status(old, new, "id", ["a", "b"]).collect()}
    assert got == {"x": ("done", 0.5), "y": ("run", 0.1), "z": ("run", 0.0)}


def test_versions_and_throughput(spark):
    names = spark.createDataFrame([("v3",), ("v12",), ("vX",), ("w9",)], "version string")
    assert tuple(runlog.version_summary(names).first()) == (13, 12, 4)
    assert tuple(runlog.version_summary(names.where("false")).first()) == (1, None, 0)
    runs = spark.createDataFrame([(10, "2024-01-01 00:00:00", "2024-01-01 00:00:04"), (10, "2024-01-01 00:00:00", "2024-01-01 00:00:00")], "record_count int, started_at string, ended_at string")
    got = runlog.run_throughput(runs).orderBy("duration").collect()
    assert [(r["duration"], r["rows_per_second"]) for r in got] == [(0.0, 0.0), (4.0, 2.5)]


def test_paging_and_newest(spark):
    df = spark.range(20).select("id", (F.col("id") % 3).alias("k"))
    assert [r["id"] for r in ranking.page(df, [F.desc("id")], F.col("k") == 0, 1, 2).collect()] == [15, 12]
    assert {r["k"]: r["id"] for r in ranking.latest_per_key(df, ["k"], ["id"]).collect()} == {0: 18, 1: 19, 2: 17}
    assert [r["id"] for r in ranking.head(df, ["id"], 3).collect()] == [0, 1, 2]
