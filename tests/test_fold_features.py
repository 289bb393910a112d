"""Statistics kept per fold against fits on the other folds' rows; sparse assembly against plain arithmetic."""

import math

import pytest
from pyspark.sql import functions as F

from alertloom.operators import models, vectors
from alertloom.spec import FeatureSpec, ModelParams, TextParams

SPEC = FeatureSpec(
    text=("t", "u"), categorical=("c",), numeric=("x",), hit_targets=("y",), message_targets=(), order=("k",),
    primary_text=TextParams(max_features=5, sublinear=True), other_text=TextParams(max_features=4),
    fallback_text=TextParams(max_features=2, ngrams=(1, 1)), model=ModelParams(rounds=3, depth=2, min_weight=0.1),
)
WORDS = ["red fox", "red dog runs", "blue fox", "", None, "blue dog red dog", "fox fox fox", "green"]


def rows(spark, n=40):
    data = [
        (i, WORDS[i % 8], "same" if i % 3 else None, None if i % 11 == 0 else f"c{i % 5}", None if i % 7 == 0 else float(i * i % 13), "ab"[i % 8 < 4], i % 4)
        for i in range(n)
    ]
    return spark.createDataFrame(data, "k long, t string, u string, c string, x double, y string, fold int").repartition(3)


def plain(fitted):
    texts = {c: sorted((r.term, r.idx, r.tf, r.df, round(r.idf, 12)) for r in v.collect()) for c, (v, _) in fitted.texts.items()}
    codes = sorted(map(tuple, fitted.codes.select("column", "value", "code").collect()))
    return texts, codes, fitted.names(), {c: p for c, (_, p) in fitted.texts.items()}


def test_folds_equal_direct_fits(spark):
    df = rows(spark)
    for fold, fitted in enumerate(vectors.fit_fold_features(df, SPEC, "fold", 4)):
        direct = vectors.fit_features(df.where(F.col("fold") != fold).drop("fold"), SPEC)
        assert plain(fitted) == plain(direct)
        assert fitted.moments == {c: pytest.approx(m) for c, m in direct.moments.items()}


def test_cross_validation_scores_every_row_once(spark):
    df = rows(spark)
    labels = spark.createDataFrame([("y", "a", 0, 20), ("y", "b", 1, 20)], "target string, class string, idx long, n long")
    (got,) = models.cross_validate(df.drop("fold"), SPEC, labels, ["k"], k=4).collect()
    assert got.target == "y" and len(got.cv_scores) == 4 and all(0 <= s <= 1 for s in got.cv_scores)
    assert got.mean_score == pytest.approx(sum(got.cv_scores) / 4) and got.min_score == min(got.cv_scores)


def test_assembled_vectors_by_hand(spark):
    df = rows(spark)
    fitted = vectors.fit_features(df.drop("fold"), SPEC)
    names = fitted.names()
    vocabulary = {r.term: r.idf for r in fitted.texts["t"][0].collect()}
    codes = {r.value: r.code for r in fitted.codes.collect()}
    mean, deviation = fitted.moments["x"]
    got = {r.k: r for r in vectors.assemble(df, fitted, ["k", "t", "c", "x"], "made").collect()}
    assert len(got) == 40
    for r in got.values():
        words = (r.t or "").split()
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        weights = {w: (1 + math.log(terms.count(w))) * vocabulary[w] for w in terms if w in vocabulary}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        want = {f"t={w}": v / norm for w, v in weights.items()}
        want["c"] = codes[r.c if r.c is not None else "Unknown"]
        want["x"] = ((r.x if r.x is not None else 0.0) - mean) / deviation
        assert r.made.size == len(names) and list(r.made.indices) == sorted(r.made.indices)
        assert {names[i]: pytest.approx(v) for i, v in zip(r.made.indices, r.made.values)} == {
            n: v for n, v in want.items() if v and n in names
        } | {n: pytest.approx(r.made[names.index(n)]) for n in names if n.startswith("u=") and r.made[names.index(n)]}


def test_selected_features_follow_a_saved_model(spark, tmp_path):
    from alertloom.sources import modelstore

    df = rows(spark).drop("fold")
    labels = spark.createDataFrame([("y", "a", 0, 20), ("y", "b", 1, 20)], "target string, class string, idx long, n long")
    model = models.fit_targets(df, SPEC, labels, k_best=3, balance=True)
    modelstore.write_model(model, str(tmp_path / "m"), spark)
    again = modelstore.read_model(spark, str(tmp_path / "m"))
    assert again.selector.getIndices() == model.selector.getIndices() and len(again.selector.getIndices()) == 3
    scores = [sorted((r.k, r.predicted_class, tuple(sorted(r.probabilities.items()))) for r in models.predict(df, m, ["k"]).collect()) for m in (model, again)]
    assert scores[0] == scores[1]
    refitted = models.fit_targets(df, again.spec, labels)
    assert refitted.targets["y"].train_accuracy >= 0.5 and again.spec == SPEC
