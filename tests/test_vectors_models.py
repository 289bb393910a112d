import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from alertloom.operators import labels, models, vectors
from alertloom.plans import jobs
from alertloom.session import scratch_path
from alertloom.sources import modelstore, runlog
from alertloom.spec import ALERTS, ModelParams, TextParams

TEXTS = ["Red fox, red dog", "red fox", "a I ?", "", "blue  dog_1 été ÉTÉ", "été fox red fox", None]
FORWARD = ALERTS.with_(
    model=ModelParams(rounds=3, depth=3), hit_targets=("hit__review_decision",), message_targets=("decision__last_action",),
)


def grams(text):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("sublinear", [False, True])
def test_tfidf_by_brute_force(spark, sublinear):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k bigint, t string")
    params = TextParams(max_features=4, sublinear=sublinear)
    documents = [Counter(grams(t)) for t in TEXTS]
    df_counts = Counter(w for d in documents for w in d)
    tf = Counter(w for d in documents for w in d.elements())
    kept = [w for w in df_counts if 2 <= df_counts[w] <= 0.9 * len(TEXTS)]
    vocabulary = sorted(sorted(kept, key=lambda w: (-tf[w], w))[:4])
    fitted = vectors.fit_tfidf(df, "t", params)
    assert [r["term"] for r in fitted.orderBy("idx").collect()] == vocabulary
    want = {}
    for k, d in enumerate(documents):
        row = {
            w: ((1 + math.log(d[w])) if sublinear else d[w]) * (math.log((1 + len(TEXTS)) / (1 + df_counts[w])) + 1)
            for w in vocabulary if d[w]
        }
        norm = math.sqrt(sum(x * x for x in row.values()))
        want.update({(k, w): pytest.approx(x / norm) for w, x in row.items()})
    got = {(r["k"], r["term"]): r["weight"] for r in vectors.transform_tfidf(df, "t", ["k"], fitted, params).collect()}
    assert got == want


def test_text_columns_fall_back_or_are_left_out(spark):
    rows = [("one two", "same words", "only", "")] + [("one three", "same words", None, "x")] + [("two", "same words", None, "y")] * 3
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    fitted = vectors.fit_text_features(df, ALERTS.with_(text=("a", "b", "c", "d")))
    assert list(fitted) == ["a"]


def test_matrix_width_does_not_depend_on_the_rows(spark):
    train = spark.createDataFrame(
        [("red fox", "a", 1.0), ("red dog", "b", 3.0), ("fox dog", "a", 5.0)], "hit__matching_text string, hit__country string, hit__score double"
    )
    fitted = vectors.fit_features(train, ALERTS)
    assert fitted.names() == [*[f"hit__matching_text={w}" for w in ("dog", "fox", "red")], "hit__country", "hit__score"]
    matrix = vectors.assemble(train, fitted, ["hit__score"])
    assert {r["features"].size for r in matrix.collect()} == {5}
    other = spark.createDataFrame([("nothing known", 1)], "hit__matching_text string, k int")
    row = vectors.assemble(other, fitted, ["k"]).first()
    assert row["features"].size == 5 and list(row["features"].toArray()[:4]) == [0, 0, 0, 0]


def test_zero_deviation_counts_as_one(spark):
    df = spark.createDataFrame([(2.0, None), (2.0, 4.0)], "a double, b double")
    moments = vectors.fit_standard(df, ["a", "b"])
    assert moments == {"a": (2.0, 1.0), "b": (2.0, 2.0)}
    assert [tuple(r) for r in vectors.standardize(df, moments).collect()] == [(0.0, -1.0), (0.0, 1.0)]


def test_balanced_weights(spark):
    df = spark.createDataFrame([("n",)] * 6 + [("p",)] * 2, "t string")
    got = {r["class"]: (r["weight"], r["scale"]) for r in models.balanced_weights(df, "t").collect()}
    assert got == {"n": (8 / 12, 3.0), "p": (2.0, 3.0)}


def test_registry(spark):
    assert models.classifier_for(ModelParams(), 2).__class__.__name__ == "SoftmaxBooster"
    assert models.make_classifier("Hierarchical_Boosting", rounds=2)(3).__class__.__name__ == "SoftmaxBooster"
    # The number of classes never changes the learner.
    assert models.make_classifier("hierarchical_boosting")(500).__class__.__name__ == "SoftmaxBooster"
    assert models.make_classifier("forest")(2).__class__.__name__ == "RandomForestClassifier"
    with pytest.raises(ValueError):
        models.make_classifier("nope")
    assert len(models.available_classifiers()) == 5


@pytest.fixture(scope="module")
def trained(spark):
    words = {"En": "the cat and the dog", "Fr": "le chat et le chien", "De": "die katze und der hund"}
    rows = [
        (i, f"{words[lang]} {i % 7}x", lang, "Release" if i % 2 else "Block", str(i % 100), "Yes" if i % 2 else "No")
        for i, lang in ((i, ["En", "Fr", "De"][i % 3]) for i in range(90))
    ]
    raw = spark.createDataFrame(
        rows, "hit__hit_id bigint, hit__matching_text string, hit__review_decision string, decision__last_action string, hit__score string, hit__is_pep string"
    )
    path, log = scratch_path(spark, "model"), scratch_path(spark, "log")
    return raw, jobs.train_job(raw, FORWARD, model_path=path, log_path=log), path, log


def test_training_learns_and_logs(spark, trained):
    raw, result, _, log = trained
    assert result.sizes == {"train": 58, "validation": 14, "test": 18}
    by_target = {r["target"]: r for r in result.test.collect()}
    assert by_target["hit__review_decision"]["weighted_f1"] > 0.95
    assert by_target["decision__last_action"]["accuracy"] > 0.95
    runs = runlog.read_log(spark, f"{log}/training_runs").collect()
    assert len(runs) == 1 and runs[0]["status"] == "completed" and runs[0]["data_size"]["train"] == 58
    assert runlog.read_log(spark, f"{log}/models").first()["model_version"] == 1


def test_scores_cover_every_row_and_survive_storage(spark, trained):
    raw, result, path, _ = trained
    scored = jobs.score_batch(raw, result.model, ["hit__hit_id"]).collect()
    assert len(scored) == 180 and {r["row_id"] for r in scored} == set(range(90))
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in scored)
    assert all(r["probabilities"][r["predicted_class"]] == max(r["probabilities"].values()) for r in scored)
    again = modelstore.read_model(spark, path)
    assert again.spec == result.model.spec and again.feature_count == result.model.feature_count
    reread = jobs.score_batch(raw, again, ["hit__hit_id"]).collect()
    key = lambda r: (r["row_id"], r["target"])
    assert [(key(r), r["predicted_class"]) for r in sorted(scored, key=key)] == [
        (key(r), r["predicted_class"]) for r in sorted(reread, key=key)
    ]


def test_a_class_missing_from_training_keeps_the_names(spark, trained):
    raw, result, _, _ = trained
    data = raw.withColumn("hit__score", F.col("hit__score").cast("double"))
    fitted = labels.fit_labels(data, FORWARD.targets)
    model = models.fit_targets(data.where("hit__review_decision <> 'En'"), FORWARD, fitted, k_best=4, balance=True)
    assert model.feature_count == 4 and model.class_names("hit__review_decision") == ["De", "Fr"]
    seen = models.predict(data, model, ["hit__hit_id"]).where("target = 'hit__review_decision'")
    assert {r["predicted_class"] for r in seen.collect()} <= {"De", "Fr"}
    assert models.feature_importance(model).count() == 8
    one = models.fit_targets(data.where("hit__review_decision = 'En'"), FORWARD, fitted)
    assert list(one.targets) == ["decision__last_action"]


def test_validation_branches(spark, trained):
    raw, result, _, _ = trained
    metrics, info = jobs.validate_job(raw, result.model)
    assert metrics.where("error IS NULL").count() == 2 and info.first()["total_samples"] == 90
    counts, info = jobs.validate_job(raw.drop(*FORWARD.targets), result.model)
    totals = counts.where("predicted_class IS NULL").collect()
    assert {r["n"] for r in totals} == {90} and info.first()["missing_targets"] == list(FORWARD.targets)


def test_model_queries_use_the_default_spec():
    from alertloom.plans.catalog import modelling
    from alertloom.spec import ALERTS

    assert modelling.SPEC == ALERTS and not hasattr(modelling, "LIGHT")
    assert (ALERTS.model.kind, ALERTS.model.rounds, ALERTS.model.depth) == ("boosted", 100, 4)
