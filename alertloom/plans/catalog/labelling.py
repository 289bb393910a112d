"""Queries for label tables and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import clean, labels, quality
from alertloom.plans.alerts import alerts, table
from alertloom.plans.catalog import sql
from alertloom.plans.catalog.registry import query
from alertloom.spec import ALERTS


def cleaned_targets(spark, sf_dir):
    """Id and targets, cleaned by role as in the train job."""
    raw = alerts(spark, sf_dir).select("hit__hit_id", *ALERTS.targets)
    return clean.normalize_categorical(clean.clean_text(raw, ALERTS.text), ALERTS.categorical)


TARGETS = (
    "targets",
    "SELECT hit__hit_id, "
    + ", ".join(
        f"{sql.clean_text(c) if 'comment' in c else sql.category(c)} AS {c}" for c in ALERTS.targets
    )
    + " FROM alerts",
)


def long_sql(source: str, columns, name: str = "target", filler: str | None = None) -> str:
    def value(c: str) -> str:
        text = f"CAST({c} AS VARCHAR)"
        if filler is not None:
            return f"coalesce({text}, '{filler}')"
        return f"coalesce({text}, '{'No Comment' if 'comment' in c else 'nan'}')"

    return " UNION ALL ".join(
        f"SELECT hit__hit_id, '{c}' AS {name}, {value(c)} AS value FROM {source}" for c in columns
    )


LABELS = [
    ("long_targets", long_sql("targets", ALERTS.targets)),
    ("counted", "SELECT target, value, count(*) AS n FROM long_targets GROUP BY 1, 2"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, value) AS place FROM counted"),
    (
        "folded",
        "SELECT target, CASE WHEN target LIKE '%comment%' AND place > 100 THEN 'Other' ELSE value END AS class, "
        "CAST(sum(n) AS BIGINT) AS n FROM ranked GROUP BY 1, 2",
    ),
    ("labels_table", "SELECT target, class, row_number() OVER (PARTITION BY target ORDER BY class) - 1 AS idx, n FROM folded"),
]
FITTED = [sql.ALERTS, TARGETS, *LABELS]
# The same on the raw targets, where nulls are still null.
RAW_FITTED = [sql.ALERTS, ("targets", "SELECT * FROM alerts"), *LABELS]

ENCODED = (
    "encoded",
    "SELECT l.hit__hit_id, l.target, coalesce(k.idx, o.idx, 0) AS idx, k.idx IS NULL AS unseen "
    "FROM long_targets l LEFT JOIN labels_table k ON k.target = l.target AND k.class = l.value "
    "LEFT JOIN labels_table o ON o.target = l.target AND o.class = 'Other' AND l.target LIKE '%comment%'",
)


@query("J1", sql.with_ctes(FITTED, "SELECT target, class, idx, n FROM labels_table"))
def fit_labels(spark, sf_dir):
    return labels.fit_labels(cleaned_targets(spark, sf_dir), ALERTS.targets)


@query("J1", sql.with_ctes(RAW_FITTED, "SELECT target, class, idx, n FROM labels_table"))
def fit_labels_with_nulls(spark, sf_dir):
    return labels.fit_labels(alerts(spark, sf_dir), ALERTS.targets)


def _wide_codes(source: str) -> str:
    return (
        "SELECT hit__hit_id, "
        + ", ".join(
            f"CAST(max(idx) FILTER (WHERE target = '{t}') AS BIGINT) AS {t}__y, "
            f"bool_or(unseen) FILTER (WHERE target = '{t}') AS {t}_unseen"
            for t in ALERTS.targets
        )
        + f" FROM {source} GROUP BY hit__hit_id"
    )


@query("J2", sql.with_ctes([*FITTED, ENCODED], _wide_codes("encoded")))
def encode_labels(spark, sf_dir):
    data = cleaned_targets(spark, sf_dir)
    fitted = labels.fit_labels(data, ALERTS.targets)
    coded = labels.encode_labels(data, fitted, ALERTS.targets, suffix="__y")
    return coded.select(
        "hit__hit_id", *[c for t in ALERTS.targets for c in (f"{t}__y", f"{t}_unseen")]
    )


@query("J3", sql.with_ctes(
    FITTED,
    "SELECT m.hit__hit_id, m.target, m.pred_idx, coalesce(k.class, 'unknown_' || m.pred_idx) AS predicted_class "
    "FROM (SELECT hit__hit_id, target, CAST(substr(hit__hit_id, 6) AS BIGINT) % 130 AS pred_idx FROM long_targets) m "
    "LEFT JOIN labels_table k ON k.target = m.target AND k.idx = m.pred_idx",
))
def decode_labels(spark, sf_dir):
    data = cleaned_targets(spark, sf_dir)
    fitted = labels.fit_labels(data, ALERTS.targets)
    long = labels.long_values(data, ALERTS.targets, labels.class_value, keep=["hit__hit_id"])
    guesses = long.select("hit__hit_id", "target", (F.substring("hit__hit_id", 6, 20).cast("bigint") % 130).alias("pred_idx"))
    return labels.decode_labels(guesses, fitted)


@query("J4", "SELECT p_size AS old, row_number() OVER (ORDER BY p_size) - 1 AS new, count(*) AS n "
             "FROM part GROUP BY p_size")
def remap_classes(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return labels.remap_classes(parts, "p_size")


@query("J5", "SELECT o_orderkey AS row_id, 'status' AS target, o_orderstatus AS y_true, "
             "CASE WHEN o_orderkey % 5 = 0 THEN 'O' ELSE o_orderstatus END AS y_pred FROM orders")
def align_truth(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.lit("status").alias("target"), "o_orderstatus"
    )
    truth = orders.withColumnRenamed("o_orderstatus", "y_true")
    guess = F.when(F.col("row_id") % 5 == 0, "O").otherwise(F.col("o_orderstatus"))
    return labels.align_truth(truth, orders.withColumn("y_pred", guess).drop("o_orderstatus"))


@query("J6", sql.with_ctes(
    [
        ("known", "SELECT DISTINCT p_brand AS value FROM part WHERE p_size = 1"),
        ("seen", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1"),
    ],
    "SELECT 'p_brand' AS target, value, n FROM seen WHERE value NOT IN (SELECT value FROM known)",
))
def unseen_values(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    fitted = labels.fit_labels(parts.where("p_size = 1"), ["p_brand"])
    return labels.unseen_values(parts, fitted, ["p_brand"])


@query("A3", sql.with_ctes(
    [
        ("counted", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1"),
        ("top", "SELECT p_brand FROM counted ORDER BY n DESC, p_brand LIMIT 10"),
    ],
    "SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM top) THEN p_brand ELSE 'Other' END AS p_brand FROM part",
))
def reduce_cardinality(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return labels.reduce_cardinality(parts, "p_brand", 10)


# Users stand for model owners, event types for statuses, event ids for runs.
_MODELS = "SELECT user_id AS model_id, user_id % 10 AS user_id, max(ts) AS created_at FROM events GROUP BY user_id"
_RUNS = "SELECT event_id AS training_id, user_id AS model_id, event_type AS status, ts AS created_at FROM events"


def _models_and_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    models = events.groupBy(F.col("user_id").alias("model_id")).agg(F.max("ts").alias("created_at"))
    models = models.withColumn("user_id", F.col("model_id") % 10)
    runs = events.select(
        F.col("event_id").alias("training_id"), F.col("user_id").alias("model_id"),
        F.col("event_type").alias("status"), F.col("ts").alias("created_at"),
    )
    return models, runs


@query("J7", sql.with_ctes(
    [
        ("models", _MODELS),
        ("runs", _RUNS),
        ("mine", "SELECT model_id FROM models WHERE user_id = 3 ORDER BY created_at DESC, model_id LIMIT 10"),
        (
            "placed",
            "SELECT r.*, row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, training_id) AS place "
            "FROM runs r WHERE model_id IN (SELECT model_id FROM mine)",
        ),
    ],
    "SELECT training_id, model_id, status FROM placed WHERE place <= 5 ORDER BY created_at DESC, training_id LIMIT 10",
))
def recent_training_runs(spark, sf_dir):
    models, runs = _models_and_runs(spark, sf_dir)
    return labels.recent_training_runs(models, runs, 3).drop("created_at")


@query("J8", sql.with_ctes(
    [("models", _MODELS), ("runs", _RUNS)],
    "SELECT r.training_id, r.model_id, r.status FROM runs r JOIN models m ON m.model_id = r.model_id WHERE m.model_id = 8",
))
def run_for_model(spark, sf_dir):
    models, runs = _models_and_runs(spark, sf_dir)
    return labels.run_for_model(models, runs, 8).select("training_id", "model_id", "status")


@query("A2", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY {c}"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber")
))
def value_counts(spark, sf_dir):
    return quality.value_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
