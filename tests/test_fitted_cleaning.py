import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import clean, sketches
from alertloom.plans import jobs
from alertloom.plans.preprocess import fit_cleaning_of, preprocess
from alertloom.session import scratch_path
from alertloom.sources import modelstore, runlog
from alertloom.spec import ALERTS, ModelParams

SPEC = ALERTS.with_(
    model=ModelParams(rounds=2, depth=2), hit_targets=("hit__review_decision",), message_targets=("decision__last_action",),
)
SCHEMA = "hit__hit_id bigint, hit__matching_text string, hit__review_decision string, decision__last_action string, hit__score string, mt103__city string"


def alerts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(n, first=0, far=0):
    """Cities that look numeric, a few scores far out."""
    return [
        (i, f"word{i % 5} text", "Release" if i % 2 else "Block", str(i % 3), str(9000 if far and i % far == 0 else i % 40), str(i % 9))
        for i in range(first, first + n)
    ]


def test_a_row_is_cleaned_alike_in_any_batch(spark):
    table = alerts(spark, rows(80, far=20))
    fitted = fit_cleaning_of(table, SPEC)
    assert "mt103__city" in fitted.numeric and fitted.fences["hit__score"] is not None
    whole = {r.hit__hit_id: r for r in preprocess(table, SPEC, fitted=fitted).collect()}
    # The city of these rows does not look numeric among themselves, and their scores are all far out.
    odd = alerts(spark, [(0, "word0 text", "Block", "0", "9000", "0"), (20, "word0 text", "Block", "2", "9000", "no city")])
    alone = {r.hit__hit_id: r for r in preprocess(odd, SPEC, is_training=False, fitted=fitted).collect()}
    assert alone[0].hit__score == whole[0].hit__score == fitted.fences["hit__score"][1]
    assert alone[0].mt103__city == whole[0].mt103__city == 0.0 and alone[20].mt103__city == 0.0
    for k in range(4):
        part = preprocess(table.where(F.col("hit__hit_id") % 4 == k), SPEC, is_training=False, fitted=fitted)
        ids = {"hit__hit_id"}
        shared = [c for c in part.columns if c in ids or not c.endswith("_id")]
        assert all(tuple(r[c] for c in shared) == tuple(whole[r.hit__hit_id][c] for c in shared) for r in part.collect())


def test_fit_is_that_of_the_batch(spark):
    table = alerts(spark, rows(60, far=15) + [(999, None, None, None, None, None)])
    plain, kept = preprocess(table, SPEC), preprocess(table, SPEC, fitted=fit_cleaning_of(table, SPEC))
    assert plain.schema == kept.schema and sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, kept.collect()), key=repr)


def test_sketches_merge_and_bound_ranks(spark):
    rnd = random.Random(4)
    values = [rnd.gauss(0, 10) for _ in range(40_000)]
    table = spark.createDataFrame([(v, None, 5.0) for v in values], "a double, b double, c double")
    parts = [table.where(F.col("a") < 2), table.where(F.col("a") >= 2)]
    merged = sketches.merge_sketches([sketches.column_sketches(p, ["a", "b", "c", "absent"]) for p in parts])
    about = {r["column"]: r for r in merged.collect()}
    assert {c: r["n"] for c, r in about.items()} == {"a": 40_000, "b": 0, "c": 40_000}
    assert (about["a"]["low"], about["a"]["high"]) == (min(values), max(values))
    values.sort()
    quantiles = sketches.sketch_quantiles(merged, {"a": (0.25, 0.5, 0.95), "b": (0.5,)})
    assert quantiles["b"] == {0.5: None}
    for p, q in quantiles["a"].items():
        assert abs(sum(v <= q for v in values) / len(values) - p) < 0.005
    fences, exact = sketches.fences_of(merged), clean.iqr_fences(table, ["a", "b", "c"])
    assert fences["b"] is None and fences["c"] is None and exact["c"] is None
    assert all(abs(x - y) < 1.0 for x, y in zip(fences["a"], exact["a"], strict=True))
    flags = {"high": ("a", 0.95), "none": ("absent", 0.5)}
    assert set(sketches.thresholds_of(merged, flags)) == {"high"}
    empty = sketches.column_sketches(table.limit(0), ["a"])
    assert sketches.fences_of(empty) == {"a": None} and sketches.fences_of(sketches.column_sketches(table, [])) == {}


def test_scores_do_not_depend_on_the_batch_and_the_fit_is_stored(spark):
    path, log, metrics = (scratch_path(spark, name) for name in ("model", "log", "metrics"))
    table = alerts(spark, rows(90, far=30))
    result = jobs.train_job(table, SPEC, model_path=path, log_path=log, metrics_path=metrics)
    model = modelstore.read_model(spark, path)
    assert model.cleaning == result.model.cleaning

    def scores(df):
        return {
            (r.hit__hit_id, r.target): (r.predicted_class, r.probabilities)
            for r in jobs.score_batch(df, model, ["hit__hit_id"]).collect()
        }

    whole, cut = scores(table), {}
    for part in (F.col("hit__hit_id") % 3 == 0, F.col("hit__hit_id") % 3 != 0):
        cut |= scores(table.where(part))
    assert whole == cut and len(whole) == 180
    run = runlog.read_log(spark, f"{log}/validation_runs").first()
    assert run["status"] == "completed" and run["data_size"]["validation"] == result.sizes["validation"]
    written = spark.read.json(f"{metrics}/test")
    assert written.count() == result.test.count()
    wide = jobs.refresh_cleaning(model, alerts(spark, [(i, "t", None, None, "4000", "1") for i in range(500, 700)]))
    assert wide.cleaning.fences["hit__score"][1] > model.cleaning.fences["hit__score"][1]
    assert wide.cleaning.numeric == model.cleaning.numeric
    model.cleaning = None
    with pytest.raises(ValueError, match="keeps no cleaning"):
        jobs.refresh_cleaning(model, table)
