"""Engineered risk, text, geography and amount features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions import text
from alertloom.functions.number import ratio
from alertloom.operators.clean import present
from alertloom.operators.quantiles import column_quantiles
from alertloom.spec import RISK_LEVELS, FeatureSpec

# Which columns make up each combined text, which batch quantile flags what.
COMBINED = {
    "combined_primary_text": (
        "hit__matching_text", "hit__watchlist_text", "decision__reviewer_comments",
    ),
    "combined_institutions": (
        "hit__Organization", "mt103__organization", "mt202__beneficiary_institution__name",
    ),
    "combined_geography": ("hit__country", "hit__city", "mt103__country", "mt103__city"),
}
HIGH_FLAGS = {
    "high_hit_count_103": ("mt103__hits_count_103", 0.75),
    "high_hit_count_202": ("mt202__hits_count_202", 0.75),
    "high_amount": ("mt202__amount", 0.90),
}


def risk_scores(
    df: DataFrame, score: str = "hit__score", fuzzy: str = "hit__fuzzy_match_score"
) -> DataFrame:
    """Weighted mean, maximum and distance of the two match scores."""
    if score not in df.columns or fuzzy not in df.columns:
        return df
    a, b = F.col(score), F.col(fuzzy)
    return df.withColumns(
        {
            "risk_score_combined": a * 0.6 + b * 0.4,
            "risk_score_max": F.greatest(a, b).cast("double"),
            "risk_score_diff": F.abs(a - b),
        }
    )


def text_shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Characters, words, distinct words and mean word length per text column."""
    columns = present(df, columns)
    # The words are split once per column, in a projection of their own.
    df = df.withColumns({f"_words_{c}": text.words(F.col(c)) for c in columns})
    made: dict[str, Column] = {}
    for c in columns:
        found = F.col(f"_words_{c}")
        letters = F.length(F.array_join(found, ""))
        made[f"{c}_length"] = F.length(c)
        made[f"{c}_word_count"] = F.size(found)
        made[f"{c}_unique_words"] = F.size(F.array_distinct(found))
        made[f"{c}_avg_word_length"] = ratio(letters, F.size(found))
    return df.withColumns(made).drop(*[f"_words_{c}" for c in columns])


def combined_texts(
    df: DataFrame, groups: Mapping[str, Sequence[str]] = COMBINED, separator: str = " | "
) -> DataFrame:
    """Present columns of each group joined; empty parts keep their separator."""
    return df.withColumns(
        {
            name: F.concat_ws(
                separator,
                *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in present(df, columns)],
            )
            for name, columns in groups.items()
            if present(df, columns)
        }
    )


def high_thresholds(
    df: DataFrame, flags: Mapping[str, tuple[str, float]] = HIGH_FLAGS, approximate: bool = False
) -> dict[str, float | None]:
    """Batch quantile behind each flag, all in the same passes."""
    used = {name: f for name, f in flags.items() if f[0] in df.columns}
    probs: dict[str, list[float]] = {}
    for column, prob in used.values():
        probs.setdefault(column, []).append(prob)
    stats = column_quantiles(df, probs, approximate=approximate)
    return {name: stats[column].quantiles[prob] for name, (column, prob) in used.items()}


def high_value_flags(
    df: DataFrame,
    flags: Mapping[str, tuple[str, float]] = HIGH_FLAGS,
    thresholds: Mapping[str, float | None] | None = None,
) -> DataFrame:
    """1 where the value is above the quantile of the batch, or above a fitted threshold."""
    if thresholds is None:
        thresholds = high_thresholds(df, flags)

    def above(column: str, bound: float | None) -> Column:
        if bound is None:
            return F.lit(0)
        return F.coalesce(F.col(column) > F.lit(bound), F.lit(False)).cast("int")

    return df.withColumns({n: above(flags[n][0], bound) for n, bound in thresholds.items()})


def _level(column: str) -> Column:
    name = F.upper(F.col(column))
    level = F.lit(None).cast("int")
    for word, value in RISK_LEVELS.items():
        level = F.when(name == word, F.lit(value)).otherwise(level)
    return F.coalesce(level, F.lit(0))


def risk_levels(
    df: DataFrame, severity: str = "hit__severity", priority: str = "hit__priority"
) -> DataFrame:
    """LOW 1, MEDIUM 2, HIGH 3, else 0, whatever the case of the value."""
    made = {"severity_score": severity, "priority_score": priority}
    return df.withColumns({n: _level(c) for n, c in made.items() if c in df.columns})


def pep_flag(df: DataFrame, column: str = "hit__is_pep") -> DataFrame:
    if column not in df.columns:
        return df
    yes = F.coalesce(F.upper(F.col(column)) == "YES", F.lit(False))
    return df.withColumn("is_pep_binary", yes.cast("int"))


def amount_log(df: DataFrame, column: str = "mt202__amount") -> DataFrame:
    if column not in df.columns:
        return df
    return df.withColumn("amount_log", F.log1p(F.col(column)))


def advanced_features(
    df: DataFrame, spec: FeatureSpec, thresholds: Mapping[str, float | None] | None = None
) -> DataFrame:
    """All engineered features whose inputs exist."""
    return (
        df.transform(risk_scores)
        .transform(text_shape, spec.text)
        .transform(combined_texts)
        .transform(high_value_flags, thresholds=thresholds)
        .transform(pep_flag)
        .transform(risk_levels)
        .transform(amount_log)
    )
