"""Evaluation of truth/prediction pairs.

Input is a long table (row_id, target, level, y_true, y_pred). One aggregation turns
it into a confusion table; every other measure is computed from that small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.number import ratio
from alertloom.spec import ACCURACY_THRESHOLD, F1_THRESHOLD, FeatureSpec

NOT_FOUND = "Target not found"


def confusion_counts(pairs: DataFrame) -> DataFrame:
    """(target, y_true, y_pred, n), only cells that occur."""
    return pairs.groupBy("target", "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """(target, y_true, y_pred, n) with zeros, over the union of the classes.

    Each class takes its row of counts from a map and lays it out along the sorted
    class list of its target.
    """
    counts = confusion_counts(pairs)
    classes = _classes(counts)
    axis = classes.groupBy("target").agg(F.sort_array(F.collect_list("class")).alias("_axis"))
    rows = counts.groupBy("target", F.col("y_true").alias("class")).agg(
        F.map_from_entries(F.collect_list(F.struct("y_pred", "n"))).alias("_row")
    )
    laid_out = classes.join(axis, "target").join(rows, ["target", "class"], "left")
    cells = F.transform(
        "_axis",
        lambda c: F.struct(
            c.alias("y_pred"),
            F.coalesce(F.try_element_at("_row", c), F.lit(0).cast("bigint")).alias("n"),
        ),
    )
    return laid_out.select("target", F.col("class").alias("y_true"), F.inline(cells))


def class_union(counts: DataFrame) -> DataFrame:
    """(target, class): classes that occur as truth or as prediction."""
    truth = counts.select("target", F.col("y_true").alias("class"))
    predicted = counts.select("target", F.col("y_pred").alias("class"))
    return truth.union(predicted).distinct()


_classes = class_union


def class_metrics(pairs: DataFrame) -> DataFrame:
    """(target, class, precision, recall, f1, support); 0 where a denominator is 0."""
    return class_metrics_of(confusion_counts(pairs))


def class_metrics_of(counts: DataFrame) -> DataFrame:
    sides = F.array(
        F.struct(
            F.col("y_true").alias("class"), F.col("n").alias("actual"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hits"),
        ),
        F.struct(
            F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("actual"),
            F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits"),
        ),
    )
    sums = (
        counts.select("target", F.inline(sides))
        .groupBy("target", "class")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])
    )
    return sums.select(
        "target",
        "class",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("actual")).alias("recall"),
        # 2pr/(p+r) from the counts, so that it stays one division.
        ratio(2 * F.col("hits"), F.col("actual") + F.col("predicted")).alias("f1"),
        F.col("actual").alias("support"),
    )


def accuracy(pairs: DataFrame) -> DataFrame:
    """(target, matches, n, accuracy)."""
    sums = pairs.groupBy("target").agg(
        F.count_if(F.col("y_true") == F.col("y_pred")).alias("matches"), F.count("*").alias("n")
    )
    return sums.withColumn("accuracy", ratio(F.col("matches"), F.col("n")))


def macro_weighted(pairs: DataFrame) -> DataFrame:
    """Per target: macro and weighted precision, recall, f1; classes and samples."""
    return macro_weighted_of(class_metrics(pairs))


def macro_weighted_of(per_class: DataFrame) -> DataFrame:
    measures = ("precision", "recall", "f1")
    weighted = [
        ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
        for m in measures
    ]
    return per_class.groupBy("target").agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *weighted,
        F.count("*").alias("classes"),
        F.sum("support").alias("samples"),
    )


def _target_metrics(pairs: DataFrame) -> DataFrame:
    counts = confusion_counts(pairs)
    right = counts.groupBy("target").agg(
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("_right"),
        F.sum("n").alias("_all"),
    )
    averages = macro_weighted_of(class_metrics_of(counts))
    return (
        averages.join(right, "target")
        .withColumn("accuracy", ratio(F.col("_right"), F.col("_all")))
        .drop("_right", "_all")
    )


def evaluate(pairs: DataFrame, spec: FeatureSpec, threshold: float = F1_THRESHOLD) -> DataFrame:
    """One row per declared target; targets without pairs get zeros and an error text.

    Only as wide as the target list, so all later summaries work on a few rows.
    """
    spark = pairs.sparkSession
    declared = spark.createDataFrame(
        [(t, spec.level_of(t)) for t in spec.targets], "target string, level string"
    )
    metrics = _target_metrics(pairs)
    found = F.col("accuracy").isNotNull()
    joined = declared.join(metrics, "target", "left")
    zeros = {
        c: F.coalesce(F.col(c), F.lit(0.0))
        for c in ("accuracy", *[f"{a}_{m}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1")])
    }
    return (
        joined.withColumn("error", F.when(~found, F.lit(NOT_FOUND)))
        .withColumns(zeros)
        .withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("classes", "samples")})
        .withColumn("meets_threshold", F.col("error").isNull() & (F.col("weighted_f1") >= threshold))
    )


def overall(metrics: DataFrame, stage: str = "validation") -> DataFrame:
    """Means over the evaluated targets, and how many meet the threshold."""
    good = F.col("error").isNull()

    def mean(c: str) -> Column:
        return F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0))

    return metrics.agg(
        mean("accuracy").alias("avg_accuracy"),
        mean("weighted_f1").alias("avg_weighted_f1"),
        F.count_if("meets_threshold").alias("targets_meeting_threshold"),
        F.count("*").alias("target_count"),
    ).withColumn("stage", F.lit(stage))


def _summary(metrics: DataFrame, threshold: float) -> DataFrame:
    good = F.col("error").isNull()
    measures = ("accuracy", "weighted_f1", "macro_f1")

    def over_good(function, m: str) -> Column:
        return F.coalesce(function(F.when(good, F.col(m))), F.lit(0.0))

    return metrics.agg(
        *[over_good(F.avg, m).alias(f"avg_{m}") for m in measures],
        *[over_good(F.stddev_pop, m).alias(f"std_{m}") for m in measures],
        F.count_if(good).alias("target_count"),
        F.count_if(good & (F.col("weighted_f1") >= threshold)).alias("targets_meeting_threshold"),
        F.count("*").alias("declared"),
    )


def overall_spread(metrics: DataFrame, threshold: float = F1_THRESHOLD) -> DataFrame:
    """Mean and population deviation over the evaluated targets."""
    return _summary(metrics, threshold).drop("declared")


def evaluate_by_level(metrics: DataFrame) -> DataFrame:
    """Mean weighted F1 per level and overall; 'effective' when both levels have targets."""
    good = metrics.where(F.col("error").isNull())

    def mean(condition: Column) -> Column:
        return F.coalesce(F.avg(F.when(condition, F.col("weighted_f1"))), F.lit(0.0))

    hit, message = F.col("level") == "hit", F.col("level") == "message"
    both = (F.count_if(hit) > 0) & (F.count_if(message) > 0)
    return good.agg(
        mean(hit).alias("hit_level_avg_f1"),
        mean(message).alias("message_level_avg_f1"),
        mean(F.lit(True)).alias("overall_avg_f1"),
        F.when(both, "effective").otherwise("limited").alias("hierarchy_effectiveness"),
    )


def class_distribution(pairs: DataFrame) -> DataFrame:
    """(target, class, support) over the union of classes; predicted-only ones have 0."""
    return class_metrics(pairs).select("target", "class", "support")


def summary_table(metrics: DataFrame) -> DataFrame:
    """One line per evaluated target with the headline measures."""
    return metrics.where(F.col("error").isNull()).select(
        F.col("target").alias("Target"),
        F.col("accuracy").alias("Accuracy"),
        F.col("weighted_f1").alias("Weighted F1"),
        F.col("macro_f1").alias("Macro F1"),
        F.col("weighted_precision").alias("Weighted Precision"),
        F.col("weighted_recall").alias("Weighted Recall"),
        F.col("classes").alias("Classes"),
        F.col("samples").alias("Samples"),
    )


DEFAULT_THRESHOLDS = {"weighted_f1": F1_THRESHOLD, "accuracy": ACCURACY_THRESHOLD}


def check_thresholds(
    metrics: DataFrame, thresholds: Mapping[str, float] = DEFAULT_THRESHOLDS
) -> DataFrame:
    """(target, metric, threshold, met); a metric that is absent is not met."""
    checks = [
        F.struct(
            F.lit(m).alias("metric"), F.lit(float(t)).alias("threshold"),
            (
                F.coalesce(F.col(m) >= F.lit(float(t)), F.lit(False))
                if m in metrics.columns
                else F.lit(False)
            ).alias("met"),
        )
        for m, t in thresholds.items()
    ]
    return metrics.select("target", F.inline(F.array(*checks)))


def _line(section: int, order: Sequence[Column], text: Column) -> list[Column]:
    keys = list(order) + [F.lit("")] * (2 - len(order))
    return [F.lit(section).alias("section"), keys[0].alias("part"), keys[1].alias("item"), text.alias("line")]


def _num(c: str) -> Column:
    return F.format_string("%.4f", F.col(c))


def performance_report(
    metrics: DataFrame, per_class: DataFrame,
    importance: DataFrame | None = None, cv: DataFrame | None = None,
    threshold: float = F1_THRESHOLD,
) -> DataFrame:
    """(section, part, item, line): report lines in reading order.

    Sections: 1 overall, 2 targets, 3 class counts, 4 top features, 5 folds, 6 verdict.
    """
    summary = _summary(metrics, threshold)
    head = summary.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(str(i)).alias("part"), text.alias("line"))
                    for i, text in enumerate(
                        [
                            F.concat(F.lit("Average Accuracy: "), _num("avg_accuracy")),
                            F.concat(F.lit("Average Weighted F1: "), _num("avg_weighted_f1")),
                            F.concat(F.lit("Average Macro F1: "), _num("avg_macro_f1")),
                            F.concat_ws(
                                "", F.lit("Targets Meeting Threshold: "),
                                F.col("targets_meeting_threshold").cast("string"),
                                F.lit("/"), F.col("declared").cast("string"),
                            ),
                        ]
                    )
                ]
            )
        )
    ).select(*_line(1, [F.col("part")], F.col("line")))
    evaluated = metrics.where(F.col("error").isNull())
    target_text = F.concat(
        F.col("target"), F.lit(": accuracy "), _num("accuracy"), F.lit(", weighted F1 "),
        _num("weighted_f1"), F.lit(", macro F1 "), _num("macro_f1"), F.lit(", classes "),
        F.col("classes").cast("string"),
    )
    report = head.unionByName(evaluated.select(*_line(2, [F.col("target")], target_text)))
    class_text = F.concat_ws(
        "", F.lit("  "), F.col("class").cast("string"), F.lit(": "), F.col("support").cast("string")
    )
    report = report.unionByName(
        per_class.select(*_line(3, [F.col("target"), F.col("class").cast("string")], class_text))
    )
    if importance is not None:
        text = F.concat(F.col("feature"), F.lit(": "), _num("importance"))
        top = importance.where(F.col("place") <= 10)
        report = report.unionByName(
            top.select(*_line(4, [F.col("target"), F.format_string("%02d", F.col("place"))], text))
        )
    if cv is not None:
        text = F.concat(
            F.col("target"), F.lit(": mean CV F1 "), _num("mean_score"), F.lit(" +- "),
            _num("std_score"), F.lit(", range "), _num("min_score"), F.lit(" to "), _num("max_score"),
        )
        report = report.unionByName(cv.select(*_line(5, [F.col("target")], text)))
    verdict = F.when(F.col("avg_weighted_f1") >= threshold, F.lit("PASS")).otherwise("FAIL")
    report = report.unionByName(summary.select(*_line(6, [F.lit("1")], verdict)))
    warning = summary.where(F.col("targets_meeting_threshold") < F.col("declared")).select(
        *_line(6, [F.lit("2")], F.lit("WARNING"))
    )
    return report.unionByName(warning)


def report_text(report: DataFrame) -> DataFrame:
    """The report as one ordered text column, ready for `write.text`."""
    return report.orderBy("section", "part", "item").select(F.col("line").alias("value"))
