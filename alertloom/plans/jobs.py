"""Train, score and validate jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators import labels as label_ops
from alertloom.operators import metrics as metric_ops
from alertloom.operators import models as model_ops
from alertloom.operators import schema
from alertloom.operators.clean import drop_empty_rows, present
from alertloom.operators.quality import prediction_distribution
from alertloom.operators.ranking import with_row_id
from alertloom.operators.sketches import column_sketches, fences_of, merge_sketches
from alertloom.operators.splits import split_train_val_test
from alertloom.plans.preprocess import coerced_by_role, fit_cleaning, preprocess
from alertloom.session import cut_lineage, stored
from alertloom.sources import runlog
from alertloom.sources.files import write_metrics_json
from alertloom.sources.modelstore import write_model
from alertloom.sources.texts import texts_to_alerts
from alertloom.spec import FeatureSpec


@dataclass
class TrainResult:
    model: model_ops.AlertModel
    validation: DataFrame
    test: DataFrame
    sizes: dict[str, int]


def train_job(
    raw: DataFrame, spec: FeatureSpec, seed: int = 42,
    model_path: str | None = None, log_path: str | None = None, user: str = "system",
    metrics_path: str | None = None,
) -> TrainResult:
    """Clean, fit classes, split, fit the targets, evaluate; optionally store, log and write the metrics.

    `metrics_path` gets one JSON folder each for validation and test. What the cleaning found out, and
    sketches of the numbers, stay with the model.
    """
    spark = raw.sparkSession
    started = datetime.now(timezone.utc)
    schema.guard_rows(raw, is_training=True)
    coerced = coerced_by_role(drop_empty_rows(raw), spec)
    cleaning, sketches = fit_cleaning(coerced, spec), cut_lineage(column_sketches(coerced, spec.numeric))
    data = stored(preprocess(raw, spec, is_training=True, fitted=cleaning))
    targets = present(data, spec.targets)
    labels = label_ops.fit_labels(data, targets)
    split = split_train_val_test(data, spec.order, targets[0] if targets else None, seed=seed)
    parts = {p: split.where(F.col("split") == p).drop("split") for p in ("train", "validation", "test")}
    model = model_ops.fit_targets(parts["train"], spec, labels)
    model.cleaning, model.sketches = cleaning, sketches
    scores = {}
    for part in ("validation", "test"):
        pairs = model_ops.truth_pairs(parts[part], model, spec.order, list(model.targets))
        scores[part] = cut_lineage(metric_ops.evaluate(pairs, spec))
        if metrics_path:
            write_metrics_json(scores[part], f"{metrics_path.rstrip('/')}/{part}")
    sizes = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if model_path:
        write_model(model, model_path, spark)
    if log_path:
        _log_training(spark, log_path, model_path, user, started, sizes, scores["validation"])
    return TrainResult(model, scores["validation"], scores["test"], sizes)


def _log_training(
    spark: SparkSession, log_path: str, model_path: str | None, user: str, started: datetime,
    sizes: dict[str, int], validation: DataFrame,
) -> None:
    ended = datetime.now(timezone.utc)
    stamp = started.strftime("%Y%m%d_%H%M%S_%f")
    means = metric_ops.overall(validation).first()
    metrics = {k: float(means[k]) for k in ("avg_accuracy", "avg_weighted_f1")}
    models = f"{log_path.rstrip('/')}/models"
    version = 1
    if runlog.exists(spark, models):
        version += runlog.read_log(spark, models).agg(F.max("model_version")).first()[0] or 0
    common = dict(user_id=user, level="both")
    runlog.log_record(
        spark, "models", models, model_id=f"model_{stamp}", model_name="alert_classifier",
        model_version=version, tag="latest", status="active", deployed=False, model_type="boosting",
        framework="spark-ml", model_path=model_path, performance_metrics=metrics, **common,
    )
    runlog.log_record(
        spark, "training_runs", f"{log_path.rstrip('/')}/training_runs",
        training_id=f"train_{stamp}", model_id=f"model_{stamp}", status="completed",
        data_size=sizes, metrics=metrics, started_at=started, ended_at=ended,
        duration=(ended - started).total_seconds(), **common,
    )
    runlog.log_record(
        spark, "validation_runs", f"{log_path.rstrip('/')}/validation_runs",
        validation_id=f"validation_{stamp}", training_id=f"train_{stamp}", model_id=f"model_{stamp}",
        status="completed", data_size={"validation": sizes.get("validation", 0)}, metrics=metrics,
        started_at=started, ended_at=ended, **common,
    )


def score_batch(
    raw: DataFrame, model: model_ops.AlertModel, keep: Sequence[str] = ()
) -> DataFrame:
    """(row_id, keep..., target, level, pred_idx, predicted_class, probabilities).

    One result per input row and fitted target, with the row's place in input order. Rows are cleaned by
    the model's fit, so that a row's result does not depend on its batch.
    """
    spec = model.spec
    data = preprocess(raw, spec, is_training=False, fitted=model.cleaning)
    # Only targets this model predicts are taken away; others are features of it.
    features = data.drop(*[t for t in model.targets if t in data.columns])
    numbered = with_row_id(features, spec.order)
    return model_ops.predict(numbered, model, ["row_id"], keep)


def refresh_cleaning(model: model_ops.AlertModel, raw: DataFrame) -> model_ops.AlertModel:
    """The model with the numbers of one more batch in its sketches and fences; no old row is read."""
    if model.cleaning is None or model.sketches is None:
        raise ValueError("the model keeps no cleaning of its training")
    spec = model.spec
    batch = column_sketches(coerced_by_role(drop_empty_rows(raw), spec), spec.numeric)
    sketches = cut_lineage(merge_sketches([model.sketches, batch]))
    fences = {**model.cleaning.fences, **fences_of(sketches)}
    return replace(model, cleaning=replace(model.cleaning, fences=fences), sketches=sketches)


def score_texts(
    texts: DataFrame, text: str, key: Sequence[str], model: model_ops.AlertModel
) -> DataFrame:
    """Predictions for bare texts."""
    return model_ops.predict(texts_to_alerts(texts, text, key), model, key)


def validate_job(raw: DataFrame, model: model_ops.AlertModel) -> tuple[DataFrame, DataFrame]:
    """(result, dataset info): metrics where half the labels are there, else class counts.

    Availability is taken from the input, before missing columns are added.
    """
    spec = model.spec
    available = present(raw, spec.targets)
    data = stored(preprocess(raw, spec, is_training=False, fitted=model.cleaning))
    info = data.agg(F.count("*").alias("total_samples")).select(
        "total_samples",
        F.array(*[F.lit(t) for t in available]).cast("array<string>").alias("available_targets"),
        F.array(*[F.lit(t) for t in spec.targets if t not in available])
        .cast("array<string>")
        .alias("missing_targets"),
        F.lit(len(schema.feature_columns(data, spec.targets).columns)).alias("feature_count"),
    )
    if model_ops.enough_truth(spec, available):
        targets = [t for t in model.targets if t in available]
        pairs = model_ops.truth_pairs(data, model, spec.order, targets)
        return metric_ops.evaluate(pairs, spec), info
    features = schema.feature_columns(data, spec.targets)
    return prediction_distribution(model_ops.predict(features, model, spec.order)), info
