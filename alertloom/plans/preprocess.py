"""From a raw alert table to the aligned, cleaned one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from alertloom.operators import clean, schema
from alertloom.spec import FeatureSpec


def clean_by_role(
    df: DataFrame, spec: FeatureSpec, order: Sequence[str] | None = None,
    fences: clean.Fences | None = None, fitted: clean.CleaningFit | None = None,
) -> DataFrame:
    """Empty rows out, text, categories, numbers with outliers clipped, numeric-looking rest,
    empty columns out. Fences and columns of this batch unless fitted ones are given.
    """
    order = tuple(order or spec.order)
    df = coerced_by_role(schema.guard_rows(df.transform(clean.drop_empty_rows), is_training=False), spec)
    if fitted is None:
        fitted = fit_cleaning(df, spec, order, fences)
    df = clean.coerce_numeric(clean.apply_fences(df, fitted.fences), fitted.numeric)
    return df.drop(*fitted.empty)


def coerced_by_role(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Text, categories and numbers cleaned, each row by itself."""
    # Text targets are cleaned as text; categories come after, as a column may be both.
    df = clean.clean_text(df, spec.text)
    df = clean.normalize_categorical(df, spec.categorical)
    return clean.coerce_numeric(df, spec.numeric)


def fit_cleaning(
    coerced: DataFrame, spec: FeatureSpec, order: Sequence[str] | None = None, fences: clean.Fences | None = None,
) -> clean.CleaningFit:
    """Fences (unless given), numeric-looking and empty columns of a table from `coerced_by_role`."""
    roles = {*spec.text, *spec.categorical, *spec.numeric}
    # Keys and labels keep their values: an id of digits and dashes is no number.
    kept = (*roles, *spec.order, spec.message_key, *spec.targets)
    if fences is None:
        fences = clean.iqr_fences(coerced, spec.numeric)
    numeric = clean.numeric_columns(coerced, tuple(order or spec.order), exclude=kept)
    # Cleaned columns hold no nulls, so only the others can be empty.
    empty = clean.empty_columns(coerced, [c for c in coerced.columns if c not in roles and c not in numeric])
    return clean.CleaningFit(fences, tuple(numeric), tuple(empty))


def fit_cleaning_of(raw: DataFrame, spec: FeatureSpec) -> clean.CleaningFit:
    """The fit of a raw alert table, to be used on later ones."""
    return fit_cleaning(coerced_by_role(clean.drop_empty_rows(raw), spec), spec)


def preprocess(
    df: DataFrame, spec: FeatureSpec, is_training: bool = True,
    order: Sequence[str] | None = None, fences: clean.Fences | None = None, min_rows: int = 1,
    fitted: clean.CleaningFit | None = None,
) -> DataFrame:
    """Guard, clean, add missing expected columns, put them in their order.

    Fitting fences and finding numeric or empty columns takes several passes, each
    reading only the columns it needs: give it a stored table rather than a long plan. With a
    `fitted` cleaning there are none, and the outcome for a row does not depend on its batch.
    """
    order = tuple(order or spec.order)
    df = schema.guard_rows(df, is_training, min_rows)
    df = clean_by_role(df, spec, order, fences, fitted)
    df = schema.align_schema(df, spec.expected, order)
    return schema.order_columns(df, spec.expected)


def preprocess_base(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The plain variant: fill nulls by role, trim names, flag message types, strip text."""
    return (
        df.transform(clean.fill_missing_by_role, spec)
        .transform(schema.strip_column_names)
        .transform(clean.mt_type_flags)
        .transform(clean.strip_text, spec.text)
    )
