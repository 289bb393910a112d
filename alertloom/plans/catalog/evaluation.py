"""Queries for the evaluation operators, on rule-made predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import metrics, quality
from alertloom.operators.models import top_features as rank_features
from alertloom.plans.alerts import table
from alertloom.plans.catalog import sql
from alertloom.plans.catalog.registry import query, rounded
from alertloom.spec import ALERTS

# target -> (level, truth, prediction): order columns stand for three of the four targets.
# '5-LOW' is never predicted and 'NONE' never true; the fourth target has no predictions.
RULES = {
    "hit__review_decision": (
        "hit", "o_orderstatus", "CASE WHEN o_orderkey % 5 = 0 THEN 'O' ELSE o_orderstatus END",
    ),
    "hit__review_comments": (
        "hit", "o_orderpriority",
        "CASE WHEN o_orderpriority = '5-LOW' THEN '3-MEDIUM' WHEN o_orderkey % 7 = 0 THEN '1-URGENT' "
        "ELSE o_orderpriority END",
    ),
    "decision__last_action": (
        "message", "c_mktsegment",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'NONE' WHEN o_orderkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END",
    ),
}


def pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("c_custkey") == F.col("o_custkey"))
    cells = [
        F.struct(
            F.lit(t).alias("target"), F.lit(level).alias("level"),
            F.expr(truth).alias("y_true"), F.expr(guess).alias("y_pred"),
        )
        for t, (level, truth, guess) in RULES.items()
    ]
    return joined.select(F.col("o_orderkey").alias("row_id"), F.inline(F.array(*cells)))


PAIRS = (
    "pairs",
    " UNION ALL ".join(
        f"SELECT o_orderkey AS row_id, '{t}' AS target, '{level}' AS level, {truth} AS y_true, {guess} AS y_pred "
        "FROM orders JOIN customer ON c_custkey = o_custkey"
        for t, (level, truth, guess) in RULES.items()
    ),
)
CLASSES = ("classes", "SELECT target, y_true AS class FROM pairs UNION SELECT target, y_pred FROM pairs")
PER_CLASS = (
    "per_class",
    "SELECT c.target, c.class, "
    "coalesce(sum(CASE WHEN y_true = c.class AND y_pred = c.class THEN 1 END) * 1.0::DOUBLE "
    "/ nullif(sum(CASE WHEN y_pred = c.class THEN 1 END), 0), 0) AS precision, "
    "coalesce(sum(CASE WHEN y_true = c.class AND y_pred = c.class THEN 1 END) * 1.0::DOUBLE "
    "/ nullif(sum(CASE WHEN y_true = c.class THEN 1 END), 0), 0) AS recall, "
    "count(*) FILTER (WHERE y_true = c.class) AS support "
    "FROM classes c JOIN pairs p ON p.target = c.target GROUP BY 1, 2",
)
WITH_F1 = (
    "with_f1",
    "SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 "
    "FROM per_class",
)
AVERAGES = (
    "averages",
    "SELECT w.target, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, "
    "sum(precision * support) / sum(support) AS weighted_precision, "
    "sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1, "
    "count(*) AS classes, CAST(sum(support) AS BIGINT) AS samples FROM with_f1 w GROUP BY 1",
)
RIGHT = ("accuracies", "SELECT target, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM pairs GROUP BY 1")
MEASURES = [f"{a}_{m}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1")]
DECLARED = (
    "declared",
    "SELECT * FROM (VALUES ('hit__review_decision', 'hit'), ('hit__review_comments', 'hit'), "
    "('decision__last_action', 'message'), ('decision__reviewer_comments', 'message')) t(target, level)",
)
EVALUATED = (
    "evaluated",
    "SELECT d.target, d.level, coalesce(a.accuracy, 0) AS accuracy, "
    + ", ".join(f"coalesce(v.{m}, 0) AS {m}" for m in MEASURES)
    + ", coalesce(v.classes, 0) AS classes, coalesce(v.samples, 0) AS samples, "
    "CASE WHEN a.accuracy IS NULL THEN 'Target not found' END AS error, "
    "coalesce(v.weighted_f1 >= 0.75, false) AS meets_threshold "
    "FROM declared d LEFT JOIN averages v ON v.target = d.target LEFT JOIN accuracies a ON a.target = d.target",
)
CHAIN = [PAIRS, CLASSES, PER_CLASS, WITH_F1, AVERAGES, RIGHT, DECLARED, EVALUATED]


@query("G1", sql.with_ctes(
    [PAIRS, CLASSES],
    "SELECT t.target, t.class AS y_true, p.class AS y_pred, count(q.row_id) AS n FROM classes t "
    "JOIN classes p ON p.target = t.target LEFT JOIN pairs q ON q.target = t.target AND q.y_true = t.class "
    "AND q.y_pred = p.class GROUP BY 1, 2, 3",
))
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(pairs(spark, sf_dir))


@query("G2", sql.with_ctes(
    CHAIN[:4],
    f"SELECT target, class, {sql.fixed('precision')} AS precision, {sql.fixed('recall')} AS recall, "
    f"{sql.fixed('f1')} AS f1, support FROM with_f1",
))
def class_metrics(spark, sf_dir):
    return rounded(metrics.class_metrics(pairs(spark, sf_dir)))


@query("G3", sql.with_ctes(
    [PAIRS],
    "SELECT target, count(*) FILTER (WHERE y_true = y_pred) AS matches, count(*) AS n, "
    f"{sql.fixed('count(*) FILTER (WHERE y_true = y_pred) / count(*)')} AS accuracy FROM pairs GROUP BY 1",
))
def accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(pairs(spark, sf_dir)))


@query("G4", sql.with_ctes(
    CHAIN[:5],
    "SELECT target, " + ", ".join(f"{sql.fixed(m)} AS {m}" for m in MEASURES) + ", classes, samples FROM averages",
))
def macro_weighted(spark, sf_dir):
    return rounded(metrics.macro_weighted(pairs(spark, sf_dir)))


EVALUATE_SQL = sql.with_ctes(
    CHAIN,
    f"SELECT target, level, {sql.fixed('accuracy')} AS accuracy, "
    + ", ".join(f"{sql.fixed(m)} AS {m}" for m in MEASURES)
    + ", classes, samples, error, meets_threshold FROM evaluated",
)


def evaluated(spark, sf_dir):
    return metrics.evaluate(pairs(spark, sf_dir), ALERTS)


@query("G5", EVALUATE_SQL)
def evaluate(spark, sf_dir):
    return rounded(evaluated(spark, sf_dir))


@query("G5", sql.with_ctes(
    CHAIN,
    f"SELECT {sql.fixed('avg(accuracy) FILTER (WHERE error IS NULL)')} AS avg_accuracy, "
    f"{sql.fixed('avg(weighted_f1) FILTER (WHERE error IS NULL)')} AS avg_weighted_f1, "
    "count(*) FILTER (WHERE meets_threshold) AS targets_meeting_threshold, count(*) AS target_count, "
    "'validation' AS stage FROM evaluated",
))
def evaluate_overall(spark, sf_dir):
    return rounded(metrics.overall(evaluated(spark, sf_dir)))


_SPREAD = ", ".join(
    f"{sql.fixed(f'avg({m})')} AS avg_{m}, {sql.fixed(f'stddev_pop({m})')} AS std_{m}"
    for m in ("accuracy", "weighted_f1", "macro_f1")
)


@query("G6", sql.with_ctes(
    CHAIN,
    f"SELECT {_SPREAD}, count(*) AS target_count, count(*) FILTER (WHERE weighted_f1 >= 0.75) "
    "AS targets_meeting_threshold FROM evaluated WHERE error IS NULL",
))
def overall_spread(spark, sf_dir):
    return rounded(metrics.overall_spread(evaluated(spark, sf_dir)))


def _mean(condition: str) -> str:
    return sql.fixed(f"coalesce(avg(weighted_f1) FILTER (WHERE {condition}), 0)")


@query("G7", sql.with_ctes(
    CHAIN,
    f"SELECT {_mean('level = ' + chr(39) + 'hit' + chr(39))} AS hit_level_avg_f1, "
    f"{_mean('level = ' + chr(39) + 'message' + chr(39))} AS message_level_avg_f1, "
    f"{_mean('true')} AS overall_avg_f1, CASE WHEN count(DISTINCT level) = 2 THEN 'effective' ELSE 'limited' END "
    "AS hierarchy_effectiveness FROM evaluated WHERE error IS NULL",
))
def evaluate_by_level(spark, sf_dir):
    return rounded(metrics.evaluate_by_level(evaluated(spark, sf_dir)))


@query("G8", sql.with_ctes(CHAIN[:3], "SELECT target, class, support FROM per_class"))
def class_distribution(spark, sf_dir):
    return metrics.class_distribution(pairs(spark, sf_dir))


@query("G9", sql.with_ctes(
    CHAIN,
    f'SELECT target AS "Target", {sql.fixed("accuracy")} AS "Accuracy", {sql.fixed("weighted_f1")} AS "Weighted F1", '
    f'{sql.fixed("macro_f1")} AS "Macro F1", {sql.fixed("weighted_precision")} AS "Weighted Precision", '
    f'{sql.fixed("weighted_recall")} AS "Weighted Recall", classes AS "Classes", samples AS "Samples" '
    "FROM evaluated WHERE error IS NULL",
))
def summary_table(spark, sf_dir):
    return rounded(metrics.summary_table(evaluated(spark, sf_dir)))


_THRESHOLDS = {"weighted_f1": 0.75, "accuracy": 0.7, "top_k_recall": 0.5}


@query("G10", sql.with_ctes(
    CHAIN,
    " UNION ALL ".join(
        f"SELECT target, '{m}' AS metric, CAST({t} AS DOUBLE) AS threshold, "
        + (f"{m} >= {t}" if m in ("weighted_f1", "accuracy") else "false")
        + " AS met FROM evaluated"
        for m, t in _THRESHOLDS.items()
    ),
))
def check_thresholds(spark, sf_dir):
    return metrics.check_thresholds(evaluated(spark, sf_dir), _THRESHOLDS)


def _four(x: str) -> str:
    return f"printf('%.4f', {x})"


def _cut(x: str) -> str:
    """Four decimals, cut off, so that no engine has to round a tie."""
    return f"floor(({x}) * 10000) / 10000"


_OVERALL = [("Average Accuracy", "accuracy"), ("Average Weighted F1", "weighted_f1"), ("Average Macro F1", "macro_f1")]
_SPREAD = {"mean_score": "avg(p_size) / 100", "std_score": "stddev_pop(p_size) / 100", "min_score": "min(p_size) / 100", "max_score": "max(p_size) / 100"}
IMPORTANCE = ("importance", f"SELECT p_type AS target, p_name AS feature, {_cut('avg(p_size)')} AS importance FROM part GROUP BY 1, 2")
REPORT = [
    *[
        f"SELECT 1 AS section, '{i}' AS part, '' AS item, '{name}: ' || {_four(f'avg({m})')} AS line FROM evaluated WHERE error IS NULL"
        for i, (name, m) in enumerate(_OVERALL)
    ],
    "SELECT 1, '3', '', 'Targets Meeting Threshold: ' || count(*) FILTER (WHERE meets_threshold) || '/' || count(*) FROM evaluated",
    f"SELECT 2, target, '', target || ': accuracy ' || {_four('accuracy')} || ', weighted F1 ' || {_four('weighted_f1')} || "
    f"', macro F1 ' || {_four('macro_f1')} || ', classes ' || classes FROM evaluated WHERE error IS NULL",
    "SELECT 3, target, class, '  ' || class || ': ' || support FROM per_class",
    f"SELECT 4, target, printf('%02d', place), feature || ': ' || {_four('importance')} FROM (SELECT *, row_number() OVER "
    "(PARTITION BY target ORDER BY importance DESC, feature) AS place FROM importance) WHERE place <= 10",
    f"SELECT 5, target, '', target || ': mean CV F1 ' || {_four('mean_score')} || ' +- ' || {_four('std_score')} || ', range ' || "
    f"{_four('min_score')} || ' to ' || {_four('max_score')} FROM spread",
    "SELECT 6, '1', '', CASE WHEN avg(weighted_f1) >= 0.75 THEN 'PASS' ELSE 'FAIL' END FROM evaluated WHERE error IS NULL",
    "SELECT 6, '2', '', 'WARNING' FROM evaluated HAVING count(*) FILTER (WHERE meets_threshold) < count(*)",
]
SPREAD = ("spread", "SELECT p_brand AS target, " + ", ".join(f"{_cut(x)} AS {c}" for c, x in _SPREAD.items()) + " FROM part GROUP BY 1")


@query("G11", sql.with_ctes([*CHAIN, IMPORTANCE, SPREAD], " UNION ALL ".join(REPORT)))
def performance_report(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    importance = parts.groupBy(F.col("p_type").alias("target"), F.col("p_name").alias("feature")).agg(
        F.expr(_cut("avg(p_size)")).cast("double").alias("importance")
    )
    folds = parts.groupBy(F.col("p_brand").alias("target")).agg(*[F.expr(_cut(x)).alias(c) for c, x in _SPREAD.items()])
    return metrics.performance_report(
        evaluated(spark, sf_dir), metrics.class_metrics(pairs(spark, sf_dir)), rank_features(importance, 10), folds
    )


@query("U2", sql.with_ctes([PAIRS, CLASSES], "SELECT target, class FROM classes"))
def class_union(spark, sf_dir):
    return metrics.class_union(metrics.confusion_counts(pairs(spark, sf_dir)))


@query("A7", sql.with_ctes(
    [PAIRS],
    "SELECT target, y_pred AS predicted_class, count(*) AS n FROM pairs GROUP BY 1, 2 "
    "UNION ALL SELECT target, NULL, count(*) FROM pairs GROUP BY 1",
))
def prediction_distribution(spark, sf_dir):
    return quality.prediction_distribution(pairs(spark, sf_dir).withColumnRenamed("y_pred", "predicted_class"))


@query("A8", sql.with_ctes(
    [PAIRS],
    "SELECT count(DISTINCT row_id) AS total_predictions, count(*) FILTER (WHERE level = 'hit') AS hit_predictions, "
    "count(*) FILTER (WHERE level = 'message') AS message_predictions FROM pairs",
))
def prediction_stats(spark, sf_dir):
    return quality.prediction_stats(pairs(spark, sf_dir))


@query("W8", sql.with_ctes(
    [
        ("importance", "SELECT p_type AS target, p_name AS feature, avg(p_size) AS importance FROM part GROUP BY 1, 2"),
        (
            "placed",
            "SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(importance, 6) DESC, feature) AS place, "
            "count(*) OVER (PARTITION BY target) AS total_features, sum(importance) OVER (PARTITION BY target) AS importance_sum "
            "FROM importance",
        ),
    ],
    f"SELECT target, feature, {sql.fixed('importance')} AS importance, CAST(place AS INTEGER) AS place, total_features, "
    f"{sql.fixed('importance_sum', 4)} AS importance_sum, "
    f"{sql.fixed('sum(importance) OVER (PARTITION BY target)', 4)} AS top_importance_sum FROM placed WHERE place <= 5",
))
def top_features(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    importance = parts.groupBy(F.col("p_type").alias("target"), F.col("p_name").alias("feature")).agg(
        F.round(F.avg("p_size"), 6).alias("importance")
    )
    top = rank_features(importance, 5)
    return top.select(
        "target", "feature", "importance", "place", "total_features",
        F.round("importance_sum", 4).alias("importance_sum"),
        F.round("top_importance_sum", 4).alias("top_importance_sum"),
    )

