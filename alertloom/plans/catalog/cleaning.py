"""Queries for the cleaning and schema operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators import clean, schema, sketches
from alertloom.plans import preprocess as plans
from alertloom.plans.alerts import alerts, landed_alerts, table
from alertloom.plans.catalog import sql
from alertloom.plans.catalog.registry import query, rounded
from alertloom.session import cut_lineage
from alertloom.spec import ALERTS, EXPECTED_COLUMNS, flat

LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("P1", sql.with_ctes(
    [sql.ALERTS],
    "SELECT hit__is_pep, hit__priority, hit__severity FROM alerts WHERE hit__is_pep IS NOT NULL "
    "OR hit__priority IS NOT NULL OR hit__severity IS NOT NULL",
))
def drop_empty_rows(spark, sf_dir):
    picked = alerts(spark, sf_dir).select("hit__is_pep", "hit__priority", "hit__severity")
    return clean.drop_empty_rows(picked)


@query("P2", sql.with_ctes([sql.ALERTS], "SELECT hit__hit_id, mt103__city FROM alerts"))
def drop_empty_columns(spark, sf_dir):
    picked = alerts(spark, sf_dir).select("hit__hit_id", "mt103__city", "mt202__value_date")
    return clean.drop_empty_columns(picked)


_ZERO = [
    "hit.account_number", "hit.country", "hit.fuzzy_match_score", "hit.score",
    "mt103.account_number", "mt103.country", "mt103.hits_count_103", "mt103.synonyms.country",
    "mt202.amount", "mt202.beneficiary_institution.address.country", "mt202.hits_count_202",
    "mt202.ordering_institution.address.country",
]
_ID = ["hit.hit_id", "message_id", "mt103.national_id"]


def _aligned_sql() -> list[str]:
    made = []
    for name in EXPECTED_COLUMNS:
        c = flat(name)
        if c in sql.COLUMNS:
            continue
        if name in _ZERO:
            made.append(f"0 AS {c}")
        elif name in _ID:
            made.append(f"row_number() OVER (ORDER BY hit__hit_id) - 1 AS {c}")
        else:
            made.append(f"'' AS {c}")
    return made


@query("P3", sql.with_ctes(
    [sql.ALERTS], "SELECT hit__hit_id, hit__country, " + ", ".join(_aligned_sql()) + " FROM alerts"
))
def align_schema(spark, sf_dir):
    raw = landed_alerts(spark, sf_dir)
    aligned = schema.align_schema(raw, ALERTS.expected, ALERTS.order)
    return aligned.drop(*[c for c in raw.columns if c not in ("hit__hit_id", "hit__country")])


@query("P4", sql.with_ctes(
    [sql.ALERTS],
    "SELECT decision__last_action, hit__hit_id, hit__score, message_id, 'x' || hit__hit_id AS extra "
    "FROM alerts",
))
def order_columns(spark, sf_dir):
    picked = alerts(spark, sf_dir).select(
        F.concat(F.lit("x"), F.col("hit__hit_id").cast("string")).alias("extra"),
        "message_id", "hit__score", "hit__hit_id", "decision__last_action",
    )
    return schema.order_columns(picked, ALERTS.expected)


_FEATURES = [c for c in sql.COLUMNS if c not in ALERTS.targets and c != "hit__matching_text"]


@query("P5", sql.with_ctes(
    [sql.ALERTS],
    "SELECT " + ", ".join(sql.fixed(c) + f" AS {c}" if c in (
        "hit__fuzzy_match_score", "mt202__amount", "mt202__charges") else c for c in _FEATURES)
    + " FROM alerts",
))
def feature_columns(spark, sf_dir):
    raw = alerts(spark, sf_dir).drop("hit__matching_text")
    return rounded(schema.feature_columns(raw, ALERTS.targets))


@query("P6", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def strip_column_names(spark, sf_dir):
    padded = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("  id "), F.col("o_orderstatus").alias("status\t")
    )
    return schema.strip_column_names(padded)


def _required_sql() -> str:
    lines = []
    for c in [*ALERTS.targets, "hit__matching_text", "mt202__currency"]:
        there = c in sql.COLUMNS
        filled = f"count({c})" if there else "CAST(0 AS BIGINT)"
        lines.append(
            f"SELECT '{c}' AS \"column\", {str(there).lower()} AS present, {filled} AS filled, "
            "count(*) AS row_count FROM alerts"
        )
    return " UNION ALL ".join(lines)


@query("P7", sql.with_ctes([sql.ALERTS], _required_sql()))
def check_required(spark, sf_dir):
    needed = [*schema.required_columns(ALERTS, is_training=True), "mt202__currency"]
    return schema.check_required(alerts(spark, sf_dir), needed)


@query("P8", sql.with_ctes(
    [sql.ALERTS],
    "SELECT hit__hit_id, " + ", ".join(f"{sql.clean_text(c)} AS {c}" for c in sql.TEXTS) + " FROM alerts",
))
def clean_text(spark, sf_dir):
    return clean.clean_text(alerts(spark, sf_dir), ALERTS.text).select("hit__hit_id", *ALERTS.text)


_CATEGORY_INPUTS = [*sql.CATEGORIES, "mt103__city"]


@query("P9", sql.with_ctes(
    [sql.ALERTS],
    "SELECT hit__hit_id, "
    + ", ".join(f"{sql.category(c)} AS {c}" for c in _CATEGORY_INPUTS) + " FROM alerts",
))
def normalize_categorical(spark, sf_dir):
    cleaned = clean.normalize_categorical(alerts(spark, sf_dir), _CATEGORY_INPUTS)
    return cleaned.select("hit__hit_id", *_CATEGORY_INPUTS)


_TYPED = {"mt103__hits_count_103": "INTEGER", "mt202__hits_count_202": "INTEGER"}


@query("P10", sql.with_ctes(
    [sql.ALERTS],
    "SELECT hit__hit_id, "
    + ", ".join(
        f"CAST({sql.number(c)} AS {_TYPED[c]}) AS {c}" if c in _TYPED
        else f"{sql.fixed(sql.number(c))} AS {c}" for c in sql.NUMBERS
    ) + " FROM alerts",
))
def coerce_numeric(spark, sf_dir):
    cleaned = clean.coerce_numeric(alerts(spark, sf_dir), ALERTS.numeric)
    return rounded(cleaned.select("hit__hit_id", *ALERTS.numeric))


@query("P11", sql.with_ctes(
    [sql.fences("lineitem", LINE_NUMBERS)],
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(f"{sql.fixed(sql.clipped(c))} AS {c}" for c in LINE_NUMBERS)
    + " FROM lineitem CROSS JOIN fences",
))
def clip_iqr(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE_NUMBERS)
    return rounded(clean.clip_iqr(lines, LINE_NUMBERS))


@query("P11", sql.with_ctes(
    sql.CLIPPED,
    "SELECT hit__hit_id, " + ", ".join(f"{sql.fixed(c)} AS {c}" for c in sql.NUMBERS) + " FROM clipped",
))
def clip_outliers_of_alerts(spark, sf_dir):
    numbers = clean.coerce_numeric(landed_alerts(spark, sf_dir), ALERTS.numeric)
    clipped = clean.clip_iqr(numbers.select("hit__hit_id", *ALERTS.numeric), ALERTS.numeric)
    return rounded(clipped.withColumns({c: F.col(c).cast("double") for c in ALERTS.numeric}))


# Fences fitted once on the whole table hold for batches that are cleaned one by one.
@query("P11 P19 M9", sql.with_ctes(
    sql.CLIPPED,
    "SELECT hit__hit_id, " + ", ".join(f"{sql.fixed(c)} AS {c}" for c in sql.NUMBERS) + " FROM clipped",
))
def clip_in_batches(spark, sf_dir):
    raw = landed_alerts(spark, sf_dir)
    fitted = plans.fit_cleaning_of(raw, ALERTS)
    batch = F.pmod(F.xxhash64("hit__hit_id"), F.lit(3))
    parts = [plans.preprocess(raw.where(batch == k), ALERTS, is_training=False, fitted=fitted) for k in range(3)]
    both = reduce(DataFrame.unionByName, [p.select("hit__hit_id", *ALERTS.numeric) for p in parts])
    return rounded(both.withColumns({c: F.col(c).cast("double") for c in ALERTS.numeric}))


# Quantiles of sketches depend on chance; their ranks must be within a hundredth.
@query("P11 F9", " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS n, {sql.fixed(f'min({c})')} AS low, {sql.fixed(f'max({c})')} AS high, true AS close FROM lineitem"
    for c in LINE_NUMBERS
))
def merged_sketches(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE_NUMBERS)
    batches = [sketches.column_sketches(lines.where(F.col("l_linenumber") % 2 == k), LINE_NUMBERS) for k in (0, 1)]
    merged = cut_lineage(sketches.merge_sketches(batches))
    found = sketches.sketch_quantiles(merged, {c: (0.25, 0.75, 0.95) for c in LINE_NUMBERS})

    def close(c):
        places = [(p, F.avg((F.col(c) < q).cast("int")), F.avg((F.col(c) <= q).cast("int"))) for p, q in found[c].items()]
        return reduce(Column.__and__, [(below <= p + 0.01) & (upto >= p - 0.01) for p, below, upto in places])

    good = lines.agg(*[close(c).alias(c) for c in LINE_NUMBERS])
    good = good.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("close")) for c in LINE_NUMBERS])))
    # One row per column.
    return rounded(merged.join(F.broadcast(good), "column").select(F.col("column").alias("name"), "n", "low", "high", "close"))


@query("P12", sql.with_ctes(
    [sql.ALERTS],
    "SELECT hit__hit_id, CAST(mt103__reference AS DOUBLE) AS mt103__reference, mt103__city, "
    "hit__severity FROM alerts",
))
def sniff_numeric(spark, sf_dir):
    raw = alerts(spark, sf_dir).select("hit__hit_id", "mt103__reference", "mt103__city", "hit__severity")
    return clean.sniff_numeric(raw, ALERTS.order, exclude=("hit__hit_id",))


def _filled_sql() -> str:
    made = [f"coalesce({c}, '') AS {c}" for c in sql.TEXTS]
    made += [f"coalesce({c}, 'Unknown') AS {c}" for c in sql.CATEGORIES]
    made += [f"{sql.fixed('coalesce(' + sql.parsed(c) + ', 0)')} AS {c}" for c in sql.NUMBERS]
    return "SELECT hit__hit_id, " + ", ".join(made) + " FROM alerts"


@query("P13", sql.with_ctes([sql.ALERTS], _filled_sql()))
def fill_missing_by_role(spark, sf_dir):
    filled = clean.fill_missing_by_role(alerts(spark, sf_dir), ALERTS)
    return rounded(filled.select("hit__hit_id", *sql.TEXTS, *sql.CATEGORIES, *sql.NUMBERS))


@query("P14", sql.with_ctes(
    [sql.ALERTS],
    "SELECT hit__hit_id, coalesce(hit__mt_type, 'MT103') AS hit__mt_type, "
    "CAST(coalesce(hit__mt_type, 'MT103') = 'MT103' AS INTEGER) AS is_mt103, "
    "CAST(coalesce(hit__mt_type, 'MT103') = 'MT202' AS INTEGER) AS is_mt202 FROM alerts",
))
def mt_type_flags(spark, sf_dir):
    return clean.mt_type_flags(alerts(spark, sf_dir).select("hit__hit_id", "hit__mt_type"))


@query("P15", sql.with_ctes(
    [sql.ALERTS],
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE CAST({c} AS VARCHAR) <> '' AND "
        f"({sql.parsed(c)}) IS NULL) AS bad_values, count(*) FILTER (WHERE CAST({c} AS VARCHAR) <> '' "
        f"AND ({sql.parsed(c)}) IS NULL) = 0 AS valid FROM alerts"
        for c in sql.NUMBERS
    ),
))
def validate_types(spark, sf_dir):
    return schema.validate_types(alerts(spark, sf_dir), ALERTS.numeric)


@query("P16", sql.with_ctes(
    [sql.ALERTS],
    " UNION ALL ".join(
        f"SELECT '{c}' AS target, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS row_count, "
        f"count(*) FILTER (WHERE {c} IS NULL) <= 0.9 * count(*) AS valid FROM alerts"
        for c in ALERTS.targets
    ),
))
def validate_targets(spark, sf_dir):
    return schema.validate_targets(alerts(spark, sf_dir), ALERTS, "both")


def _strict_sql() -> str:
    lines = ["SELECT 'rows' AS rule, '' AS name, count(*) > 0 AS met FROM alerts"]
    lines += [
        f"SELECT 'column', '{c}', {str(c in sql.COLUMNS).lower()}"
        for c in schema.required_columns(ALERTS, is_training=True, strict=True)
    ]
    lines += [
        f"SELECT 'type', '{c}', count(*) FILTER (WHERE CAST({c} AS VARCHAR) <> '' AND ({sql.parsed(c)}) IS NULL) = 0 FROM alerts"
        for c in sql.NUMBERS
    ]
    lines += [f"SELECT 'target', '{c}', count(*) FILTER (WHERE {c} IS NULL) <= 0.9 * count(*) FROM alerts" for c in ALERTS.targets]
    return " UNION ALL ".join(lines)


@query("P7 P15 P16", sql.with_ctes([sql.ALERTS], _strict_sql()))
def strict_report(spark, sf_dir):
    return schema.strict_report(alerts(spark, sf_dir), ALERTS, is_training=True)


@query("P17", sql.with_ctes(
    [sql.ALERTS],
    "SELECT hit__hit_id, 'decision__last_action' AS target, decision__last_action AS value FROM alerts "
    "UNION ALL SELECT hit__hit_id, 'decision__reviewer_comments', decision__reviewer_comments FROM alerts",
))
def filter_level(spark, sf_dir):
    long = alerts(spark, sf_dir).select("hit__hit_id", *ALERTS.targets).unpivot(
        "hit__hit_id", list(ALERTS.targets), "target", "value"
    )
    return schema.filter_level(long, ALERTS, "message")


_STAGE = [c for c in sql.TEXTS + sql.CATEGORIES + sql.NUMBERS if c not in ALERTS.hit_targets]


@query("P18", sql.with_ctes(
    [sql.ALERTS],
    "SELECT hit__hit_id, " + ", ".join(
        f"{sql.fixed(c)} AS {c}" if c in ("hit__fuzzy_match_score", "mt202__amount", "mt202__charges")
        else c for c in _STAGE
    ) + " FROM alerts",
))
def stage_columns(spark, sf_dir):
    return rounded(schema.stage_columns(alerts(spark, sf_dir), ALERTS, "hit"))


def _preprocessed_sql() -> str:
    made = ["hit__hit_id", "message_id", "mt103__city"]
    made += ["CAST(mt103__reference AS DOUBLE) AS mt103__reference"]
    made += sql.TEXTS + sql.CATEGORIES + [f"{sql.fixed(c)} AS {c}" for c in sql.NUMBERS]
    made += _aligned_sql() + ["'' AS mt202__value_date"]
    return "SELECT " + ", ".join(made) + " FROM clipped"


@query("P19", sql.with_ctes(sql.CLIPPED, _preprocessed_sql()))
def preprocess(spark, sf_dir):
    return rounded(plans.preprocess(landed_alerts(spark, sf_dir), ALERTS))


def _base_sql() -> str:
    def stripped(c: str) -> str:
        value = sql.strip(f"coalesce({c}, '')")
        return f"CASE WHEN {value} = 'nan' THEN '' ELSE {value} END AS {c}"

    made = [stripped(c) for c in sql.TEXTS]
    made += [
        f"coalesce({c}, '{'Unknown'}') AS {c}" for c in sql.CATEGORIES if c != "hit__mt_type"
    ]
    made += [
        "coalesce(hit__mt_type, 'Unknown') AS hit__mt_type",
        "CAST(coalesce(hit__mt_type, 'Unknown') = 'MT103' AS INTEGER) AS is_mt103",
        "CAST(coalesce(hit__mt_type, 'Unknown') = 'MT202' AS INTEGER) AS is_mt202",
    ]
    made += [f"{sql.fixed('coalesce(' + sql.parsed(c) + ', 0)')} AS {c}" for c in sql.NUMBERS]
    return "SELECT hit__hit_id, " + ", ".join(made) + " FROM alerts"


@query("P20", sql.with_ctes([sql.ALERTS], _base_sql()))
def preprocess_base(spark, sf_dir):
    done = plans.preprocess_base(alerts(spark, sf_dir), ALERTS)
    columns = ["hit__hit_id", *sql.TEXTS, *sql.CATEGORIES, "is_mt103", "is_mt202", *sql.NUMBERS]
    return rounded(done.select(*columns))
