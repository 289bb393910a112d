"""Keys survive cleaning, and splits never fail in silence."""

import pytest
from pyspark.sql import functions as F

from alertloom.operators import quality, schema, splits
from alertloom.plans.preprocess import preprocess
from alertloom.sources import nested
from alertloom.spec import ALERTS


def rows(spark, ids):
    made = [(i, f"m{k // 2}", f"text {k}", ["a", "b"][k % 2], str(k % 7), k if k % 3 else None) for k, i in enumerate(ids)]
    names = "hit__hit_id string, message_id string, hit__matching_text string, hit__review_decision string, hit__tag string, extra int"
    return spark.createDataFrame(made, names)


@pytest.mark.parametrize("shape", ["2024-{:06d}", "1.2.{}", "{}", "{}-"])
def test_ids_of_digits_stay_and_split(spark, shape):
    ids = [shape.format(k) for k in range(200)]
    clean = preprocess(rows(spark, ids), ALERTS).select(*ALERTS.order, "message_id", "hit__review_decision", "hit__tag", "extra")
    assert sorted(r.hit__hit_id for r in clean.collect()) == sorted(ids)
    assert dict(clean.dtypes)["hit__tag"] == "double" and clean.where("extra IS NULL").isEmpty()
    sizes = splits.split_train_val_test(clean, ALERTS.order, "hit__review_decision").groupBy("split").count()
    assert {r.split: r["count"] for r in sizes.collect()} == {"test": 40, "validation": 30, "train": 130}


def test_equal_keys_are_an_error(spark):
    same = rows(spark, ["2024-1"] * 100)
    with pytest.raises(ValueError, match="not unique"):
        splits.split_train_val_test(same, ALERTS.order, "hit__review_decision")


def test_missing_ids_are_numbered(spark):
    aligned = schema.align_schema(rows(spark, range(50)).drop("hit__hit_id"), ALERTS.expected, ALERTS.order)
    assert sorted(r.hit__hit_id for r in aligned.select("hit__hit_id").collect()) == list(range(50))


def test_rows_a_microsecond_apart_are_no_copies(spark):
    df = spark.range(2).select(F.expr("timestamp_micros(1700000000000000 + id)").alias("ts"), F.lit(1).alias("x"))
    both = df.withColumn("n", F.col("ts").cast("timestamp_ntz"))
    assert quality.duplicate_rows(both).first()[0] == 0
    assert quality.duplicate_rows(both.union(both)).first()[0] == 2


def test_broken_alerts_are_rejected_and_typed_values_kept(spark):
    good = '{"message_id": "1", "total_hits": 3, "blocking_hits": [{"hit_id": "h", "score": 85.5, "priority": "LOW"}]}'
    texts = spark.createDataFrame([(good,), ('{"message_id": "2", ',), ('{"message_id": "3", "total_hits": "many"}',), (None,)], "value string")
    flat = nested.flatten_alerts(nested.parse_alerts(texts)).collect()
    assert [(r.message_id, r.total_hits, r.hit__score, r.hit__priority) for r in flat] == [("1", 3, 85.5, "LOW")]
    assert nested.rejected_alerts(texts).count() == 3
