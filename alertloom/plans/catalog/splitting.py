"""Queries for splits, folds, row numbers, sorting and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import ranking, splits
from alertloom.plans.alerts import table
from alertloom.plans.catalog import sql
from alertloom.plans.catalog.registry import query

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def counts_cte(source: str, stratum: str) -> tuple[str, str]:
    return ("counts", f"SELECT {stratum} AS s, count(*) AS n FROM {source} GROUP BY 1")


def shared_out(name: str, source: str, size: str, draws: str, made: str) -> list[tuple[str, str]]:
    """CTEs that split `draws` over the strata by largest remainder."""
    total = f"(SELECT sum({size}) FROM {source})"
    return [
        (
            f"{name}_base",
            f"SELECT *, ({size}::HUGEINT * {draws}) // {total} AS base, ({size}::HUGEINT * {draws}) % {total} AS rem FROM {source}",
        ),
        (
            name,
            f"SELECT * EXCLUDE (base, rem, place), base + CASE WHEN place <= {draws} - (SELECT sum(base) FROM {name}_base) "
            f"THEN 1 ELSE 0 END AS {made} FROM (SELECT *, row_number() OVER (ORDER BY rem DESC, s) AS place FROM {name}_base)",
        ),
    ]


def ordered(source: str, stratum: str, keys: list[str], seed: int = 42) -> tuple[str, str]:
    text = "concat_ws(':', '%d', %s)" % (seed, ", ".join(keys))
    return (
        "ordered",
        f"SELECT {', '.join(keys)}, {stratum} AS s, row_number() OVER (PARTITION BY {stratum} ORDER BY md5({text})) AS place FROM {source}",
    )


def three_way(source: str, stratum: str, test: float = 0.2, validation: float = 0.15) -> list[tuple[str, str]]:
    n_test = f"(SELECT CAST(ceil(sum(n) * CAST({test} AS DOUBLE)) AS BIGINT) FROM counts)"
    n_rest = f"((SELECT CAST(sum(n) AS BIGINT) FROM counts) - {n_test})"
    share = f"(CAST({validation} AS DOUBLE) / (1 - CAST({test} AS DOUBLE)))"
    n_validation = f"CAST(ceil({n_rest} * {share}) AS BIGINT)"
    return [
        counts_cte(source, stratum),
        *shared_out("rest", "counts", "n", n_rest, "r"),
        *shared_out("train", "rest", "r", f"({n_rest} - {n_validation})", "t"),
        ("quotas", "SELECT s, n - r AS n_test, r - t AS n_validation, t AS n_train FROM train"),
    ]


def labelled(keys: list[str]) -> str:
    return (
        f"SELECT {', '.join(keys)}, CASE WHEN place <= n_test THEN 'test' WHEN place <= n_test + n_validation THEN 'validation' "
        "WHEN place <= n_test + n_validation + n_train THEN 'train' END AS split FROM ordered JOIN quotas ON quotas.s = ordered.s"
    )


SPLIT_CTES = [*three_way("documents", "lang"), ordered("documents", "lang", ["doc_id"])]


@query("W2", sql.with_ctes(SPLIT_CTES, labelled(["doc_id"])))
def split_train_val_test(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.split_train_val_test(documents, ["doc_id"], "lang").drop("lang")


@query("W2", sql.with_ctes(
    [*three_way("lineitem", "l_returnflag", 0.25, 0.1), ordered("lineitem", "l_returnflag", LINE_KEY)], labelled(LINE_KEY)
))
def split_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag")
    return splits.split_train_val_test(lines, LINE_KEY, "l_returnflag", 0.25, 0.1).drop("l_returnflag")


@query("W4", sql.with_ctes(
    [
        counts_cte("orders", "o_orderpriority"),
        *shared_out(
            "rest", "counts", "n",
            "((SELECT CAST(sum(n) AS BIGINT) FROM counts) - (SELECT CAST(ceil(sum(n) * CAST(0.2 AS DOUBLE)) AS BIGINT) FROM counts))",
            "r",
        ),
        ordered("orders", "o_orderpriority", ["o_orderkey"], 7),
    ],
    "SELECT o_orderkey, CASE WHEN place <= n - r THEN 'test' ELSE 'train' END AS split FROM ordered JOIN rest ON rest.s = ordered.s",
))
def split_train_test(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return splits.split_train_test(orders, ["o_orderkey"], "o_orderpriority", seed=7).drop("o_orderpriority")


@query("W5", sql.with_ctes(
    [
        counts_cte("lineitem", "l_returnflag"),
        *shared_out("rest", "counts", "n", "((SELECT CAST(sum(n) AS BIGINT) FROM counts) - 200)", "r"),
        *shared_out("train", "rest", "r", "15435", "t"),
        ("remaining", "SELECT *, r - t AS l FROM train"),
        *shared_out("validation", "remaining", "l", "1800", "v"),
        ("quotas", "SELECT s, n - r AS n_test, v AS n_validation, t AS n_train FROM validation"),
        ordered("lineitem", "l_returnflag", LINE_KEY),
    ],
    labelled(LINE_KEY),
))
def split_exact(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag")
    return splits.split_exact(lines, LINE_KEY, "l_returnflag").drop("l_returnflag")


_N_TRAIN = "(SELECT CAST(floor(sum(n) * (CAST(15435 AS DOUBLE) / 17435)) AS BIGINT) FROM counts)"
_N_REST = f"((SELECT CAST(sum(n) AS BIGINT) FROM counts) - {_N_TRAIN})"
_SHARE = "((CAST(1800 AS DOUBLE) / 17435) / (CAST(1800 AS DOUBLE) / 17435 + CAST(200 AS DOUBLE) / 17435))"


@query("W5", sql.with_ctes(
    [
        counts_cte("part", "p_type"),
        *shared_out("train", "counts", "n", _N_TRAIN, "t"),
        ("remaining", "SELECT *, n - t AS l FROM train"),
        *shared_out("validation", "remaining", "l", f"CAST(floor({_N_REST} * {_SHARE}) AS BIGINT)", "v"),
        ("quotas", "SELECT s, l - v AS n_test, v AS n_validation, t AS n_train FROM validation"),
        ordered("part", "p_type", ["p_partkey"]),
    ],
    labelled(["p_partkey"]),
))
def split_exact_proportional(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return splits.split_proportional(parts, ["p_partkey"], "p_type").drop("p_type")


@query("W3", sql.with_ctes(
    [
        counts_cte("part", "p_brand"),
        ("starts", "SELECT s, n, sum(n) OVER (ORDER BY s) - n AS start FROM counts"),
        ("folds", "SELECT s, CAST(f AS INTEGER) AS fold, count(*) AS size FROM (SELECT s, unnest(generate_series(start::BIGINT, (start + n - 1)::BIGINT)) % 5 AS f FROM starts) GROUP BY 1, 2"),
        ("ends", "SELECT s, fold, sum(size) OVER (PARTITION BY s ORDER BY fold) AS upto, size FROM folds"),
        ordered("part", "p_brand", ["p_partkey"]),
    ],
    "SELECT p_partkey, fold FROM ordered JOIN ends ON ends.s = ordered.s AND place <= upto AND place > upto - size",
))
def kfold(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return splits.kfold(parts, ["p_partkey"], 5, 42, "p_brand").drop("p_brand")


@query("A9", sql.with_ctes(
    [*SPLIT_CTES, ("labelled", labelled(["doc_id"]))],
    "SELECT split, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM labelled), 2)::DOUBLE AS percent FROM labelled GROUP BY 1 "
    "UNION ALL SELECT 'total', count(*), 100.0::DOUBLE FROM labelled",
))
def split_summary(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.split_summary(splits.split_train_val_test(documents, ["doc_id"], "lang"))


@query("W1", "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_id, "
             "l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def with_row_id(spark, sf_dir):
    return ranking.with_row_id(table(spark, sf_dir, "lineitem").select(*LINE_KEY), LINE_KEY)


@query("W6", sql.with_ctes(
    [("placed", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events")],
    "SELECT user_id, event_id, event_type, props FROM placed WHERE place = 1",
))
def latest_per_key(spark, sf_dir):
    newest = ranking.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    return newest.select("user_id", "event_id", "event_type", "props")


@query("W7", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 10 OFFSET 20")
def page(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = [F.desc("ts"), F.asc("event_id")]
    return ranking.page(events, newest, F.col("event_type") == "error", 20, 10).select("event_id", "user_id")


@query("W9", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def head(spark, sf_dir):
    return ranking.head(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 100)
