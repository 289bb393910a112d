"""Queries for classifiers: the default learners, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import labels, models, vectors
from alertloom.plans import jobs
from alertloom.plans.alerts import landed_alerts, table
from alertloom.plans.catalog import sql
from alertloom.plans.catalog.labelling import FITTED
from alertloom.plans.catalog.registry import query, rounded
from alertloom.plans.preprocess import preprocess
from alertloom.session import stored
from alertloom.spec import ALERTS

SPEC = ALERTS
_PREPARED: dict[tuple[str, str], tuple] = {}
_FITTED: dict[tuple[str, str], tuple] = {}

CLASS_COUNTS = ("class_counts", "SELECT target, count(*) AS classes, max(n) AS most, sum(n) AS samples FROM labels_table GROUP BY 1")
TARGET_LIST = ("targets_list", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{ALERTS.level_of(t)}')" for t in ALERTS.targets) + ") t(target, level)")


def prepared(spark, sf_dir):
    """(cleaned alerts, classes, features), made once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PREPARED:
        data = stored(preprocess(landed_alerts(spark, sf_dir), SPEC))
        _PREPARED[key] = (data, labels.fit_labels(data, SPEC.targets), vectors.fit_features(data, SPEC))
    return _PREPARED[key]


def fitted(spark, sf_dir):
    """(cleaned alerts, model), fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        data, classes, features = prepared(spark, sf_dir)
        _FITTED[key] = (data, models.fit_targets(data, SPEC, classes, features=features))
    return _FITTED[key]


def _decisions(spark, sf_dir):
    """(matrix with the codes of the review decisions, features); no classifier is fitted for it."""
    data, classes, features = prepared(spark, sf_dir)
    encoded = labels.encode_labels(data, classes, ["hit__review_decision"], suffix="__y")
    return vectors.assemble(encoded, features, ["hit__review_decision__y"]), features


def _known(scored, model):
    """True where the predicted class is a fitted one and has the predicted code."""
    classes = model.labels.select("target", F.col("class").alias("predicted_class"), F.col("idx").alias("pred_idx"))
    return scored.join(classes.withColumn("known", F.lit(True)), ["target", "predicted_class", "pred_idx"], "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


# At least as good on the rows it was fitted on as naming the most frequent class.
@query("M5 J4", sql.with_ctes(
    [*FITTED, CLASS_COUNTS],
    "SELECT target, CASE WHEN target LIKE '%comments' THEN 'forest' ELSE 'boosted' END AS kind, "
    "CAST(classes AS INTEGER) AS classes, CAST(samples AS BIGINT) AS samples, true AS learned FROM class_counts",
))
def fit_targets(spark, sf_dir):
    _, model = fitted(spark, sf_dir)
    counts = model.labels.groupBy("target").agg(F.max("n").alias("most")).collect()
    most = {r.target: r.most for r in counts}
    rows = [
        (t, models.kind_of(m.model), len(m.classes), model.sample_count, m.train_accuracy >= most[t] / model.sample_count - 1e-9)
        for t, m in model.targets.items()
    ]
    return spark.createDataFrame(rows, "target string, kind string, classes int, samples bigint, learned boolean")


@query("M7 J3", sql.with_ctes(
    [sql.ALERTS, TARGET_LIST], "SELECT hit__hit_id, target, level, true AS known FROM alerts CROSS JOIN targets_list"
))
def predict(spark, sf_dir):
    data, model = fitted(spark, sf_dir)
    scored = _known(models.predict(data, model, ["hit__hit_id"]), model)
    return scored.select("hit__hit_id", "target", "level", "known")


# Every row and target gets a probability for each class, and the predicted class has the largest.
@query("M8", sql.with_ctes(
    [*FITTED, CLASS_COUNTS],
    "SELECT hit__hit_id, target, CAST(classes AS INTEGER) AS classes, true AS within, true AS total_is_one, true AS largest "
    "FROM alerts CROSS JOIN class_counts",
))
def predict_proba(spark, sf_dir):
    data, model = fitted(spark, sf_dir)
    scored = models.predict(data, model, ["hit__hit_id"])
    given = F.map_values("probabilities")
    total = F.aggregate(given, F.lit(0.0), lambda acc, p: acc + p)
    return scored.select(
        "hit__hit_id", "target", F.size("probabilities").alias("classes"),
        F.forall(given, lambda p: (p >= 0) & (p <= 1)).alias("within"), (F.abs(total - 1) < 1e-9).alias("total_is_one"),
        (F.col("probabilities")[F.col("predicted_class")] >= F.array_max(given)).alias("largest"),
    )


@query("M9 W1", sql.with_ctes(
    [sql.ALERTS, TARGET_LIST],
    "SELECT row_number() OVER (PARTITION BY target ORDER BY hit__hit_id) - 1 AS row_id, hit__hit_id, target, level, true AS known "
    "FROM alerts CROSS JOIN targets_list",
))
def score_batch(spark, sf_dir):
    _, model = fitted(spark, sf_dir)
    scored = _known(jobs.score_batch(landed_alerts(spark, sf_dir), model, ["hit__hit_id"]), model)
    return scored.select("row_id", "hit__hit_id", "target", "level", "known")


@query("M10 S6", sql.with_ctes([TARGET_LIST], "SELECT doc_id, target, level, true AS known FROM documents CROSS JOIN targets_list"))
def score_texts(spark, sf_dir):
    _, model = fitted(spark, sf_dir)
    scored = jobs.score_texts(table(spark, sf_dir, "documents"), "text", ["doc_id"], model)
    return _known(scored, model).select("doc_id", "target", "level", "known")


@query("M11 G5", sql.with_ctes(
    [*FITTED, CLASS_COUNTS], "SELECT target, CAST(samples AS BIGINT) AS samples, true AS learned FROM class_counts"
))
def validate(spark, sf_dir):
    _, model = fitted(spark, sf_dir)
    metrics, _ = jobs.validate_job(landed_alerts(spark, sf_dir), model)
    most = model.labels.groupBy("target").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return metrics.join(most, "target").select(
        "target", F.col("samples").cast("bigint").alias("samples"), (F.col("accuracy") >= F.col("most") / F.col("all") - 1e-9).alias("learned")
    )


@query("M11", sql.with_ctes(
    [sql.ALERTS],
    "SELECT count(*) AS total_samples, 'hit__review_decision,hit__review_comments,decision__reviewer_comments' AS available, "
    "'decision__last_action' AS missing FROM alerts",
))
def validation_info(spark, sf_dir):
    _, model = fitted(spark, sf_dir)
    _, info = jobs.validate_job(landed_alerts(spark, sf_dir).drop("decision__last_action"), model)
    return info.select(
        "total_samples", F.array_join("available_targets", ",").alias("available"), F.array_join("missing_targets", ",").alias("missing")
    )


@query("M11 A7", sql.with_ctes(
    [sql.ALERTS, TARGET_LIST], "SELECT target, count(*) AS total, count(*) AS listed FROM alerts CROSS JOIN targets_list GROUP BY target"
))
def validate_without_labels(spark, sf_dir):
    _, model = fitted(spark, sf_dir)
    counts, _ = jobs.validate_job(landed_alerts(spark, sf_dir).drop(*ALERTS.targets), model)
    named = F.col("predicted_class").isNotNull()
    return counts.groupBy("target").agg(
        F.sum(F.when(~named, F.col("n"))).alias("total"), F.sum(F.when(named, F.col("n"))).alias("listed")
    )


@query("M12 W8", sql.with_ctes([TARGET_LIST], "SELECT target, 20::BIGINT AS shown, true AS sum_is_one, true AS falling FROM targets_list"))
def feature_importance(spark, sf_dir):
    _, model = fitted(spark, sf_dir)
    top = models.top_features(models.feature_importance(model), 20)
    return top.groupBy("target").agg(
        F.count("*").alias("shown"), (F.abs(F.max("importance_sum") - 1) < 1e-6).alias("sum_is_one"),
        ((F.min("importance") >= 0) & (F.max("top_importance_sum") <= F.max("importance_sum") + 1e-9)).alias("falling"),
    )


@query("M4", "SELECT 50::BIGINT AS picked, 50::BIGINT AS different, true AS known")
def select_k_best(spark, sf_dir):
    matrix, features = _decisions(spark, sf_dir)
    selector = models.select_k_best(matrix, "hit__review_decision__y", 50)
    names = features.names()
    rows = spark.createDataFrame([(int(i), names[i]) for i in selector.getIndices()], "idx int, feature string")
    return rows.agg(
        F.count("*").alias("picked"), F.countDistinct("feature").alias("different"), (F.max("idx") < len(names)).alias("known")
    )


@query("M6", "SELECT c AS class, n, " + sql.fixed("1.0::DOUBLE * t / (k * n)") + " AS weight, CASE WHEN k = 2 THEN "
             + sql.fixed("1.0::DOUBLE * lo / hi") + " END AS scale FROM (SELECT l_linestatus AS c, count(*) AS n, sum(count(*)) OVER () AS t, "
             "count(*) OVER () AS k, arg_min(count(*), l_linestatus) OVER () AS lo, arg_max(count(*), l_linestatus) OVER () AS hi "
             "FROM lineitem GROUP BY 1)")
def balanced_weights(spark, sf_dir):
    return rounded(models.balanced_weights(table(spark, sf_dir, "lineitem"), "l_linestatus"))


def _part_sizes() -> str:
    """Rows of each part: the test part is rounded up, then the validation part of the rest."""
    test = "CAST(ceil(n * CAST(0.2 AS DOUBLE)) AS BIGINT)"
    share = "(CAST(0.15 AS DOUBLE) / (1 - CAST(0.2 AS DOUBLE)))"
    return f"SELECT n, {test} AS test, CAST(ceil((n - {test}) * {share}) AS BIGINT) AS validation FROM (SELECT count(*) AS n FROM alerts)"


@query("M13 W2 J1 J2 G5", sql.with_ctes(
    [sql.ALERTS, TARGET_LIST, ("sizes", _part_sizes())],
    " UNION ALL ".join(
        f"SELECT '{part}' AS part, {part} AS rows, target, {part} AS samples, true AS sane FROM sizes CROSS JOIN targets_list"
        for part in ("validation", "test")
    ),
))
def train_job(spark, sf_dir):
    result = jobs.train_job(landed_alerts(spark, sf_dir), SPEC)
    parts = [
        getattr(result, part).withColumn("part", F.lit(part)).withColumn("rows", F.lit(result.sizes[part]).cast("bigint"))
        for part in ("validation", "test")
    ]
    sane = F.col("accuracy").between(0, 1) & F.col("weighted_f1").between(0, 1) & F.isnull("error")
    return parts[0].unionByName(parts[1]).select("part", "rows", "target", F.col("samples").cast("bigint").alias("samples"), sane.alias("sane"))


@query("G12 W3", sql.with_ctes([TARGET_LIST], "SELECT target, 5 AS folds, true AS mean_agrees, true AS spread_agrees, true AS within FROM targets_list"))
def cross_validate(spark, sf_dir):
    data = stored(preprocess(landed_alerts(spark, sf_dir), SPEC))
    classes = labels.fit_labels(data, SPEC.targets)
    scores = models.cross_validate(data, SPEC, classes, SPEC.order, k=5)
    mean = F.aggregate("cv_scores", F.lit(0.0), lambda a, x: a + x) / F.size("cv_scores")
    spread = F.sqrt(F.aggregate(F.transform("cv_scores", lambda x: x * x), F.lit(0.0), lambda a, x: a + x) / F.size("cv_scores") - mean * mean)
    return scores.select(
        "target", F.size("cv_scores").alias("folds"), (F.abs(mean - F.col("mean_score")) < 1e-9).alias("mean_agrees"),
        (F.abs(spread - F.col("std_score")) < 1e-6).alias("spread_agrees"),
        ((F.array_min("cv_scores") == F.col("min_score")) & (F.array_max("cv_scores") == F.col("max_score"))).alias("within"),
    )


@query("G13 G10", "SELECT * FROM (VALUES ('model_trained', true), ('has_predictions', true), ('meets_f1_threshold', NULL), ('meets_accuracy_threshold', NULL)) t(\"check\", met)")
def model_requirements(spark, sf_dir):
    data, model = fitted(spark, sf_dir)
    checks = models.model_requirements(data, model, ["hit__hit_id"])
    # Whether the thresholds are met depends on the fit; the first two checks may not fail.
    return checks.select("check", F.when(~F.col("check").startswith("meets"), F.col("met")).alias("met"))


@query("X1", "SELECT name, true AS learned FROM (VALUES " + ", ".join(f"('{n}')" for n in models.available_classifiers()) + ") t(name)")
def make_classifier(spark, sf_dir):
    """Each registered name makes a classifier that learns the language of a text to some extent."""
    matrix, _ = _decisions(spark, sf_dir)
    rows = stored(matrix.withColumn("label", F.col("hit__review_decision__y").cast("double")))
    classes = rows.select("label").distinct().count()
    # Several names stand for one learner; it is fitted once.
    learned, made = {}, []
    for name in models.available_classifiers():
        classifier = models.make_classifier(name.upper())(classes)
        kind = type(classifier).__name__
        if kind not in learned:
            learned[kind] = models.train_accuracy(rows, classifier.fit(rows)) > 0.5
        made.append((name, learned[kind]))
    return spark.createDataFrame(made, "name string, learned boolean")
