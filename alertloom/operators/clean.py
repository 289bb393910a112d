"""Role-based cleaning: empty rows and columns, text, categories, numbers, outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions import number, text
from alertloom.operators.quantiles import column_quantiles
from alertloom.spec import FeatureSpec

Fences = Mapping[str, tuple[float, float] | None]


@dataclass(frozen=True)
class CleaningFit:
    """What cleaning finds out from a whole table: outlier fences, columns that look numeric, empty columns.

    Kept with a model, it makes the cleaning of a row depend on that row alone.
    """

    fences: Fences
    numeric: tuple[str, ...]
    empty: tuple[str, ...]


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose every column is null.

    The test names every column. As a plain predicate it would become a constraint
    that the optimizer rewrites for each subset of renamed columns, so planning a
    wide table would not end. The row number keeps it from being one; whether a
    row stays depends on its columns alone.
    """
    filled = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(1)) for c in df.columns])
    return df.where(F.when(filled.isNotNull(), F.monotonically_increasing_id()).isNotNull())


def empty_columns(df: DataFrame, candidates: Sequence[str] | None = None) -> list[str]:
    """Columns that are null in every row; one aggregation for all of them."""
    columns = df.columns if candidates is None else present(df, candidates)
    if not columns:
        return []
    # max of a flag instead of a count: one byte of state per column.
    seen = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in columns]).first()
    return [c for c in columns if not seen[c]]


def drop_empty_columns(df: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """Drop columns that are null in every row."""
    return df.drop(*empty_columns(df, candidates))


def clean_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stripped strings; null and null words become the empty string."""
    return df.withColumns({c: text.clean_text(F.col(c)) for c in present(df, columns)})


def normalize_categorical(
    df: DataFrame, columns: Sequence[str], null_token: str = "Nan"
) -> DataFrame:
    """Stripped, title-cased categories with yes/no spellings unified."""
    columns = present(df, columns)
    # Two projections, so that the title case is worked out once and looked up after.
    df = df.withColumns({c: text.titled(F.col(c), null_token) for c in columns})
    return df.withColumns({c: text.unified(F.col(c)) for c in columns})


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers, with 0 for whatever does not parse."""
    types = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: number.coerce(F.col(c), types[c]) for c in present(df, columns)})


def iqr_fences(
    df: DataFrame, columns: Sequence[str], k: float = 1.5, approximate: bool = False
) -> Fences:
    """Lower and upper fence per column; None where the spread is zero."""
    columns = present(df, columns)
    stats = column_quantiles(df, {c: (0.25, 0.75) for c in columns}, approximate=approximate)
    fences: dict[str, tuple[float, float] | None] = {}
    for c, s in stats.items():
        q1, q3 = s.quantiles[0.25], s.quantiles[0.75]
        spread = None if q1 is None else q3 - q1
        if spread is None or s.low == s.high or not spread > 0:
            fences[c] = None
        else:
            fences[c] = (q1 - k * spread, q3 + k * spread)
    return fences


def apply_fences(df: DataFrame, fences: Fences) -> DataFrame:
    """Clip each column to its fences."""
    def clipped(c: str, low: float, high: float) -> Column:
        value = F.col(c).cast("double")
        # greatest/least skip nulls, so nulls are kept explicitly.
        return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))

    return df.withColumns({c: clipped(c, *f) for c, f in fences.items() if f and c in df.columns})


def clip_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Clip to the fences of this very batch."""
    return apply_fences(df, iqr_fences(df, columns, k))


def numeric_looking(
    df: DataFrame, order: Sequence[str], columns: Sequence[str],
    sample: int | None = None, ratio: float = 0.8,
) -> list[str]:
    """String columns whose non-null values are mostly digits.

    One narrow aggregation over all rows decides. With `sample`, the first so many
    non-null values of each column in the given order decide instead.
    """
    types = {f.name: f.dataType for f in df.schema}
    columns = [c for c in columns if isinstance(types[c], T.StringType)]
    if not columns:
        return []

    def digits(value: Column) -> Column:
        return F.regexp_replace(value, "[.-]", "").rlike(r"^\p{Nd}+$")

    if sample is None:
        counts = [F.struct(F.count(c).alias("n"), F.count_if(digits(F.col(c))).alias("digits")).alias(c) for c in columns]
        found = df.agg(*counts).first()
        return [c for c in columns if found[c].digits > found[c].n * ratio]
    head = _first_values(_long_form(df, order, columns), order, sample, digits)
    return [r["column"] for r in head if r["digits"] > r["n"] * ratio]


def _long_form(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    )
    return df.select(*keys, F.inline(pairs)).where(F.col("value").isNotNull())


def _first_values(long: DataFrame, order: Sequence[str], sample: int, digits) -> list:
    from pyspark.sql import Window

    place = F.row_number().over(
        Window.partitionBy("column").orderBy(*[f"_k{i}" for i in range(len(order))])
    )
    return (
        long.withColumn("_place", place)
        .where(F.col("_place") <= sample)
        .groupBy("column")
        .agg(F.count("*").alias("n"), F.count_if(digits(F.col("value"))).alias("digits"))
        .collect()  # one row per column
    )


def sniff_numeric(
    df: DataFrame, order: Sequence[str], exclude: Sequence[str] = (),
    sample: int | None = None, ratio: float = 0.8,
) -> DataFrame:
    """Coerce every other column that looks numeric; nulls of numeric columns become 0.

    Columns of `order` are keys and stay as they are, whatever they look like.
    """
    return coerce_numeric(df, numeric_columns(df, order, exclude, sample, ratio))


def numeric_columns(
    df: DataFrame, order: Sequence[str], exclude: Sequence[str] = (),
    sample: int | None = None, ratio: float = 0.8,
) -> list[str]:
    """The columns that `sniff_numeric` coerces."""
    others = [c for c in df.columns if c not in exclude and c not in order]
    types = {f.name: f.dataType for f in df.schema}
    found = numeric_looking(df, order, others, sample, ratio)
    return found + [c for c in others if isinstance(types[c], T.NumericType)]


def fill_missing_by_role(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Nulls: text '' , numbers 0, categories 'Unknown'."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in present(df, spec.text)}
    for c in present(df, spec.numeric):
        filled[c] = F.coalesce(number.parse(F.col(c)), F.lit(0.0))
    for c in present(df, spec.categorical):
        filled.setdefault(c, F.coalesce(F.col(c).cast("string"), F.lit("Unknown")))
    return df.withColumns(filled)


def mt_type_flags(df: DataFrame, column: str = "hit__mt_type") -> DataFrame:
    """Default the message type and flag the two known ones; no-op without the column."""
    if column not in df.columns:
        return df
    kind = F.coalesce(F.col(column).cast("string"), F.lit("MT103"))
    return df.withColumns(
        {
            column: kind,
            "is_mt103": (kind == "MT103").cast("int"),
            "is_mt202": (kind == "MT202").cast("int"),
        }
    )


def strip_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The plain variant of text cleaning: strip, and 'nan' becomes empty."""
    def cleaned(c: str) -> Column:
        value = text.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.when(value == "nan", F.lit("")).otherwise(value)

    return df.withColumns({c: cleaned(c) for c in present(df, columns)})
