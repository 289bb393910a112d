"""Column sets: alignment, order, projections, required-column and type checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions import number
from alertloom.operators.clean import present
from alertloom.operators.ranking import with_row_id
from alertloom.session import is_small
from alertloom.spec import ID_MARKER, ZERO_MARKERS, FeatureSpec


def default_kind(column: str) -> str:
    """Default of a missing column, by substring of its name: zero, id or blank."""
    lowered = column.lower()
    if any(m in lowered for m in ZERO_MARKERS):
        return "zero"
    return "id" if ID_MARKER in lowered else "blank"


def align_schema(df: DataFrame, expected: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add the missing expected columns with their defaults.

    Ids number the rows in the given order, or in input order where a column of the order is
    itself missing; that sort runs only if an id is missing.
    """
    missing = [c for c in expected if c not in df.columns]
    ids = [c for c in missing if default_kind(c) == "id"]
    if ids and all(c in df.columns for c in order):
        df = with_row_id(df, order, "_row_id")
    elif ids:
        df = with_row_id(df.withColumn("_input", F.monotonically_increasing_id()), ["_input"], "_row_id").drop("_input")
    values = {"zero": F.lit(0), "id": F.col("_row_id") if ids else None, "blank": F.lit("")}
    return df.withColumns({c: values[default_kind(c)] for c in missing}).drop("_row_id")


def order_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected columns first, the others after in input order."""
    return df.select(*present(df, expected), *[c for c in df.columns if c not in expected])


def feature_columns(
    df: DataFrame, targets: Sequence[str], exclude_targets: bool = True
) -> DataFrame:
    """Project the label columns away; absent ones are ignored."""
    return df.drop(*targets) if exclude_targets else df


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def stage_columns(df: DataFrame, spec: FeatureSpec, level: str) -> DataFrame:
    """Features plus the other level's targets, which a stage may use as input."""
    other = spec.targets_of("message" if level == "hit" else "hit")
    own = spec.targets_of(level)
    features = [
        c for c in present(df, [*spec.text, *spec.categorical, *spec.numeric]) if c not in own
    ]
    extra = [c for c in present(df, other) if c not in features]
    return df.select(*present(df, spec.order), *features, *extra)


def missing_columns(required: DataFrame, actual: DataFrame) -> DataFrame:
    """Names in `required` that are not in `actual`."""
    return required.select("column").subtract(actual.select("column"))


def observed_columns(df: DataFrame) -> DataFrame:
    """Names of the columns that hold a value somewhere, with how many values."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in df.columns]
    return counts.select(F.inline(F.array(*pairs))).where("filled > 0")


def check_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: is it there, and how many values does it hold."""
    there = present(df, required)
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in there]
    )
    report = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(c in there).alias("present"),
            (F.col(c) if c in there else F.lit(0).cast("bigint")).alias("filled"),
            F.col("_rows").alias("row_count"),
        )
        for c in required
    ]
    return counts.select(F.inline(F.array(*report)))


def required_columns(spec: FeatureSpec, is_training: bool, strict: bool = False) -> list[str]:
    """Columns to check for: labels and the main text, or the strict list."""
    if not strict:
        return [*spec.targets, *spec.text[:1]]
    labels = spec.targets if is_training else ()
    features = (*spec.text, *spec.categorical, *spec.numeric)
    return list(dict.fromkeys([*spec.required, *labels, *features]))


def strict_report(df: DataFrame, spec: FeatureSpec, is_training: bool, level: str = "both") -> DataFrame:
    """(rule, name, met): rows there, every required column, numbers that parse, usable targets."""
    needed = required_columns(spec, is_training, strict=True)
    there = check_required(df, needed).select(F.lit("column").alias("rule"), F.col("column").alias("name"), F.col("present").alias("met"))
    rows = df.limit(1).agg((F.count("*") > 0).alias("met")).select(F.lit("rows").alias("rule"), F.lit("").alias("name"), "met")
    report = rows.unionByName(there)
    if present(df, spec.numeric):
        report = report.unionByName(
            validate_types(df, spec.numeric).select(F.lit("type").alias("rule"), F.col("column").alias("name"), F.col("valid").alias("met"))
        )
    if is_training and present(df, spec.targets_of(level)):
        report = report.unionByName(
            validate_targets(df, spec, level).select(F.lit("target").alias("rule"), F.col("target").alias("name"), F.col("valid").alias("met"))
        )
    return report


def validate_strict(df: DataFrame, spec: FeatureSpec, is_training: bool, level: str = "both") -> bool:
    """False when empty, a required column is missing, or types or targets do not hold."""
    return bool(strict_report(df, spec, is_training, level).agg(F.min("met")).first()[0])


def guard_rows(df: DataFrame, is_training: bool, min_rows: int = 1) -> DataFrame:
    """Raise when the table is empty, or in training has too few rows."""
    if df.isEmpty():
        raise ValueError("dataset is empty")
    if is_training and min_rows > 1 and is_small(df, min_rows - 1):
        raise ValueError(f"fewer than {min_rows} rows for training")
    return df


def validate_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: how many values are neither numbers nor null or empty."""
    there = present(df, columns)

    def bad(c: str):
        text = F.col(c).cast("string")
        return text.isNotNull() & (text != "") & number.parse(text).isNull()

    counts = df.agg(*[F.count_if(bad(c)).alias(c) for c in there])
    report = [
        F.struct(
            F.lit(c).alias("column"), F.col(c).alias("bad_values"), (F.col(c) == 0).alias("valid")
        )
        for c in there
    ]
    return counts.select(F.inline(F.array(*report)))


def validate_targets(
    df: DataFrame, spec: FeatureSpec, level: str, max_null: float = 0.9
) -> DataFrame:
    """Null counts of the level's targets, and whether each is usable."""
    targets = present(df, spec.targets_of(level))
    if not targets:
        raise ValueError(f"no {level} target columns in the table")
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in targets]
    )
    report = [
        F.struct(
            F.lit(c).alias("target"),
            F.col(c).alias("nulls"),
            F.col("_rows").alias("row_count"),
            (F.col(c) <= F.col("_rows") * F.lit(max_null)).alias("valid"),
        )
        for c in targets
    ]
    return counts.select(F.inline(F.array(*report)))


def targets_usable(df: DataFrame, spec: FeatureSpec, level: str = "both") -> bool:
    return bool(validate_targets(df, spec, level).agg(F.min("valid")).first()[0])


def filter_level(long: DataFrame, spec: FeatureSpec, level: str) -> DataFrame:
    """Rows of a long target table that belong to the level."""
    return long.where(F.col("target").isin(*spec.targets_of(level)))
