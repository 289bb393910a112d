"""Queries for message-level and quality aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import quality, schema
from alertloom.plans.alerts import alerts, table
from alertloom.plans.catalog import sql
from alertloom.plans.catalog.registry import query, rounded
from alertloom.spec import ALERTS


def _mode_cte(source: str, key: str, column: str) -> tuple[str, str]:
    return (
        f"mode_{column}",
        f"SELECT {key}, {column} FROM (SELECT {key}, {column}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {column}) AS place "
        f"FROM {source} WHERE {column} IS NOT NULL GROUP BY 1, 2) WHERE place = 1",
    )


def _first(column: str, order: str) -> str:
    return f"arg_min({column}, {order}) FILTER (WHERE {column} IS NOT NULL)"


_LINE_ORDER = "ROW(l_linenumber, l_partkey, l_suppkey)"


@query("A1", sql.with_ctes(
    [_mode_cte("lineitem", "l_orderkey", "l_returnflag"), _mode_cte("lineitem", "l_orderkey", "l_linestatus")],
    f"SELECT f.*, r.l_returnflag, s.l_linestatus FROM (SELECT l_orderkey, {_first('l_partkey', _LINE_ORDER)} AS l_partkey, "
    f"{_first('l_quantity', _LINE_ORDER)} AS l_quantity FROM lineitem GROUP BY 1) f "
    "LEFT JOIN mode_l_returnflag r ON r.l_orderkey = f.l_orderkey LEFT JOIN mode_l_linestatus s ON s.l_orderkey = f.l_orderkey",
))
def lines_to_orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
    )
    _, orders = quality.to_message_level(
        lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus"]
    )
    return orders.drop("l_linenumber", "l_suppkey")


_PLAIN = ["hit__matching_text", "hit__is_pep", "hit__severity", "hit__score", "decision__last_action"]


@query("A1", sql.with_ctes(
    [
        sql.ALERTS,
        _mode_cte("alerts", "message_id", "hit__review_decision"),
        _mode_cte("alerts", "message_id", "hit__review_comments"),
    ],
    "SELECT f.*, d.hit__review_decision, c.hit__review_comments FROM (SELECT message_id, "
    + ", ".join(f"{_first(c, 'hit__hit_id')} AS {c}" for c in _PLAIN)
    + " FROM alerts GROUP BY 1) f LEFT JOIN mode_hit__review_decision d ON d.message_id = f.message_id "
    "LEFT JOIN mode_hit__review_comments c ON c.message_id = f.message_id",
))
def to_message_level(spark, sf_dir):
    hits = alerts(spark, sf_dir).select("message_id", "hit__hit_id", *_PLAIN, *ALERTS.hit_targets)
    _, messages = quality.to_message_level(hits, "message_id", ALERTS.order, ALERTS.hit_targets)
    return messages.drop("hit__hit_id")


def _quality_sql() -> str:
    columns = list(sql.COLUMNS)
    nulls = " + ".join(f"count(*) - count({c})" for c in columns)
    lines = [
        "SELECT 'total_rows' AS metric, '' AS name, count(*)::DOUBLE AS value FROM alerts",
        f"SELECT 'total_columns', '', {len(columns)}::DOUBLE",
        f"SELECT 'missing_ratio', '', {sql.fixed(f'({nulls}) / (count(*) * {len(columns)})')} FROM alerts",
        "SELECT 'duplicate_rows', '', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM alerts)))::DOUBLE FROM alerts",
    ]
    for c in sql.TEXTS:
        lines.append(
            f"SELECT 'empty_text_ratio', '{c}', {sql.fixed(f'count(*) FILTER (WHERE length({c}) = 0) / count(*)')} FROM alerts"
        )
    coverage = {"text_columns": 5 / 5, "categorical_columns": 9 / 13, "numerical_columns": 6 / 6}
    for role, share in coverage.items():
        lines.append(f"SELECT 'feature_coverage', '{role}', {sql.fixed(str(share))}")
    for c in ALERTS.targets:
        lines.append(
            f"SELECT 'target_distribution:{c}', {c}, count(*)::DOUBLE FROM alerts WHERE {c} IS NOT NULL GROUP BY {c}"
        )
    return " UNION ALL ".join(lines)


@query("A4", sql.with_ctes([sql.ALERTS], _quality_sql()))
def data_quality(spark, sf_dir):
    return rounded(quality.data_quality(alerts(spark, sf_dir), ALERTS))


@query("A4", "SELECT CAST((SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT) AS duplicate_rows")
def duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(table(spark, sf_dir, "documents").select("text", "lang"))


@query("A4", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id % 20 AS u, event_type, ts FROM events)) AS duplicate_rows FROM events")
def duplicate_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return quality.duplicate_rows(events.select((F.col("user_id") % 20).alias("u"), "event_type", "ts"))


_MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("A5", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS prob, {sql.fixed(f'quantile_cont({c}, {p})')} AS quantile FROM lineitem"
    for c in _MEASURED for p in _PROBS
))
def column_quantiles(spark, sf_dir):
    return rounded(quality.quantile_table(table(spark, sf_dir, "lineitem"), _MEASURED, _PROBS))


_COUNTED = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"]


@query("A6", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in _COUNTED
))
def distinct_counts(spark, sf_dir):
    return quality.distinct_counts(table(spark, sf_dir, "lineitem"), _COUNTED)


@query("U3", sql.with_ctes(
    [sql.ALERTS],
    "SELECT \"column\" FROM (VALUES ('hit__hit_type'), ('mt202__value_date'), ('mt202__currency'), ('hit__country')) t(\"column\") "
    "EXCEPT (SELECT 'hit__hit_type' FROM alerts HAVING count(hit__hit_type) > 0 UNION SELECT 'mt202__value_date' FROM alerts "
    "HAVING count(mt202__value_date) > 0 UNION SELECT 'hit__country' FROM alerts HAVING count(hit__country) > 0)",
))
def missing_columns(spark, sf_dir):
    wanted = [("hit__hit_type",), ("mt202__value_date",), ("mt202__currency",), ("hit__country",)]
    required = spark.createDataFrame(wanted, "column string")
    return schema.missing_columns(required, schema.observed_columns(alerts(spark, sf_dir)))


@query("S2", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def guard_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag")
    guarded = schema.guard_rows(lines, is_training=True, min_rows=100)
    return guarded.groupBy("l_returnflag").agg(F.count("*").alias("n"))
