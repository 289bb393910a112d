import pytest
from pyspark.sql import functions as F

from alertloom.operators import features, labels, metrics
from alertloom.spec import ALERTS


def test_comment_classes_are_folded(spark):
    rows = [(f"c{i:03d}",) for i in range(105) for _ in range(2 if i < 50 else 1)] + [(None,)] * 3
    fitted = labels.fit_labels(spark.createDataFrame(rows, "hit__review_comments string"), ["hit__review_comments"], top_n=100)
    got = {r["class"]: (r["idx"], r["n"]) for r in fitted.collect()}
    assert len(got) == 101 and got["Other"][1] == 6 and got["No Comment"][1] == 3
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1][0])] == sorted(got)


def test_unseen_classes(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "y")], "hit__review_decision string, hit__review_comments string")
    fitted = labels.fit_labels(train, train.columns)
    test = spark.createDataFrame([("a", "new"), ("zz", "y")], train.schema)
    got = labels.encode_labels(test, fitted, train.columns, suffix="__y").orderBy("hit__review_decision").collect()
    assert [(r["hit__review_decision__y"], r["hit__review_comments__y"]) for r in got] == [(0, 0), (0, 1)]
    assert [(r["hit__review_decision_unseen"], r["hit__review_comments_unseen"]) for r in got] == [(False, True), (True, False)]
    assert {(r["target"], r["value"]) for r in labels.unseen_values(test, fitted, train.columns).collect()} == {
        ("hit__review_decision", "zz"), ("hit__review_comments", "new"),
    }


def test_decoding_out_of_range(spark):
    fitted = labels.fit_labels(spark.createDataFrame([("b",), ("a",)], "t string"), ["t"])
    guesses = spark.createDataFrame([("t", 0), ("t", 1), ("t", 7)], "target string, pred_idx bigint")
    got = [r["predicted_class"] for r in labels.decode_labels(guesses, fitted).orderBy("pred_idx").collect()]
    assert got == ["a", "b", "unknown_7"]
    got = [r["predicted_class"] for r in labels.decode_labels(guesses, fitted, unknown="Unknown").orderBy("pred_idx").collect()]
    assert got[-1] == "Unknown"


def test_reduced_cardinality_keeps_nulls(spark):
    df = spark.createDataFrame([(v,) for v in ["a", "a", "b", "b", "c", None]], "v string")
    assert sorted(str(r["v"]) for r in labels.reduce_cardinality(df, "v", 1).collect()) == ["None", "Other", "Other", "Other", "a", "a"]


def test_missing_run_is_an_error(spark):
    models = spark.createDataFrame([("m1", "u")], "model_id string, user_id string")
    runs = spark.createDataFrame([("t1", "m1"), ("t2", "mX")], "training_id string, model_id string")
    assert [r["training_id"] for r in labels.require_run(models, runs, "m1").collect()] == ["t1"]
    with pytest.raises(LookupError):
        labels.require_run(models, runs, "mX")


def pairs(spark):
    rows = [("hit__review_decision", "hit", t, p) for t, p in zip("aabbbc", "abbbad")]
    df = spark.createDataFrame(rows, "target string, level string, y_true string, y_pred string")
    return df.withColumn("row_id", F.monotonically_increasing_id())


def test_class_measures(spark):
    got = {r["class"]: r for r in metrics.class_metrics(pairs(spark)).collect()}
    assert (got["b"]["precision"], got["b"]["recall"], got["b"]["support"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 3)
    assert (got["c"]["precision"], got["c"]["f1"], got["d"]["support"], got["d"]["recall"]) == (0, 0, 0, 0)
    means = metrics.macro_weighted(pairs(spark)).first()
    assert means["macro_f1"] == pytest.approx((0.5 + 2 / 3) / 4)
    assert means["weighted_f1"] == pytest.approx((2 * 0.5 + 3 * 2 / 3) / 6)
    matrix = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion_matrix(pairs(spark)).collect()}
    assert len(matrix) == 16 and matrix[("a", "b")] == 1 and matrix[("d", "d")] == 0 and sum(matrix.values()) == 6


def test_evaluation_report(spark):
    scored = metrics.evaluate(pairs(spark), ALERTS)
    by_target = {r["target"]: r for r in scored.collect()}
    assert len(by_target) == 4 and by_target["hit__review_comments"]["error"] == "Target not found"
    assert metrics.overall(scored).first()["avg_accuracy"] == pytest.approx(0.5)
    assert metrics.evaluate_by_level(scored).first()["hierarchy_effectiveness"] == "limited"
    report = metrics.performance_report(scored, metrics.class_metrics(pairs(spark)))
    lines = [r["value"] for r in metrics.report_text(report).collect()]
    assert lines[0] == "Average Accuracy: 0.5000" and lines[-2:] == ["FAIL", "WARNING"]
    met = {r["metric"]: r["met"] for r in metrics.check_thresholds(scored, {"accuracy": 0.5, "other": 0.1}).where("target = 'hit__review_decision'").collect()}
    assert met == {"accuracy": True, "other": False}


def test_no_pairs_at_all(spark):
    none = metrics.overall(metrics.evaluate(pairs(spark).where("false"), ALERTS)).first()
    assert (none["avg_accuracy"], none["targets_meeting_threshold"], none["target_count"]) == (0.0, 0, 4)


def test_text_shape_of_blank_text(spark):
    df = spark.createDataFrame([(0, ""), (1, " a  bb a ")], "k int, t string")
    got = features.text_shape(df, ["t"]).orderBy("k").collect()
    assert [(r["t_word_count"], r["t_unique_words"], r["t_avg_word_length"]) for r in got] == [(0, 0, 0.0), (3, 2, pytest.approx(4 / 3))]


def test_amount_log_of_negatives_is_null(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,)], "mt202__amount double")
    assert [r["amount_log"] for r in features.amount_log(df).collect()] == [None, 0.0]
