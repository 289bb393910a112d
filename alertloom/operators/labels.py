"""Target classes: fitting, encoding, decoding, and the small joins around them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.clean import present
from alertloom.operators.frequent import most_frequent
from alertloom.operators.ranking import index_within
from alertloom.session import broadcast_if_small, cut_lineage
from alertloom.spec import TOP_COMMENTS

NO_COMMENT = "No Comment"
OTHER = "Other"
COMMENT_MARK = "comment"


def is_comment(target: str) -> bool:
    return COMMENT_MARK in target.lower()


def class_value(target: str) -> Column:
    """The class of a row as a string, before rare comments are folded."""
    filler = NO_COMMENT if is_comment(target) else "nan"
    return F.coalesce(F.col(target).cast("string"), F.lit(filler))


def long_values(
    df: DataFrame, columns: Sequence[str], value, name: str = "target", keep: Sequence[str] = ()
) -> DataFrame:
    """(keep..., name, value): one row per row and column, without a shuffle."""
    pairs = [F.struct(F.lit(c).alias(name), value(c).alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def fit_labels(df: DataFrame, targets: Sequence[str], top_n: int = TOP_COMMENTS) -> DataFrame:
    """(target, class, idx, n): classes in code-point order, numbered from 0.

    Comment targets keep their `top_n` most frequent values (ties: smaller value
    first); the rest becomes 'Other'. Values of the other targets are counted with a partial
    sum before the shuffle; of comments, only those that may be frequent are.
    """
    targets = present(df, targets)
    comments = [t for t in targets if is_comment(t)]
    plain = [t for t in targets if not is_comment(t)]
    parts = []
    if plain:
        counts = long_values(df, plain, class_value).groupBy("target", "value").agg(F.count("*").alias("n"))
        parts.append(counts.select("target", F.col("value").alias("class"), "n"))
    if comments:
        parts.append(_fold_rare(long_values(df, comments, class_value), top_n))
    return index_within(reduce(DataFrame.unionByName, parts), ["target"], ["class"], "idx").select("target", "class", "idx", "n")


def _fold_rare(rows: DataFrame, top_n: int) -> DataFrame:
    top = most_frequent(rows, top_n)
    totals = rows.groupBy("target").agg(F.count("*").alias("_all"))
    kept = top.groupBy("target").agg(F.sum("n").alias("_kept"))
    rest = (
        totals.join(kept, "target")
        .where(F.col("_all") > F.col("_kept"))
        .select("target", F.lit(OTHER).alias("class"), (F.col("_all") - F.col("_kept")).alias("n"))
    )
    named = top.select("target", F.col("value").alias("class"), "n").unionByName(rest)
    # A comment may itself read 'Other'.
    return named.groupBy("target", "class").agg(F.sum("n").alias("n"))


def target_classes(labels: DataFrame, target: str) -> DataFrame:
    return labels.where(F.col("target") == target).select("class", "idx")


def encode_labels(
    df: DataFrame, labels: DataFrame, targets: Sequence[str], suffix: str = ""
) -> DataFrame:
    """Class -> number. Unseen comments count as 'Other' if that was fitted, else 0.

    Adds `{target}{suffix}` and, with a suffix, the flag `{target}_unseen`.
    """
    for t in present(df, targets):
        known = target_classes(labels, t).select(
            F.col("class").alias("_class"), F.col("idx").alias("_idx")
        )
        fallback = 0
        if is_comment(t):
            other = target_classes(labels, t).where(F.col("class") == OTHER).select("idx").first()
            fallback = other[0] if other else 0
        joined = df.join(broadcast_if_small(known), class_value(t) == F.col("_class"), "left")
        made = {f"{t}{suffix}": F.coalesce("_idx", F.lit(fallback).cast("bigint"))}
        if suffix:
            made[f"{t}_unseen"] = F.col("_idx").isNull()
        df = joined.withColumns(made).drop("_class", "_idx")
    return df


def decode_labels(
    predictions: DataFrame, labels: DataFrame, idx: str = "pred_idx",
    unknown: str | None = None, name: str = "predicted_class",
) -> DataFrame:
    """Number -> class for a long (target, idx) table.

    A number out of range becomes `unknown`, or `unknown_<number>` by default.
    """
    known = labels.select("target", F.col("idx").alias(idx), F.col("class").alias("_class"))
    filler = (
        F.concat(F.lit("unknown_"), F.col(idx).cast("string"))
        if unknown is None
        else F.lit(unknown)
    )
    return (
        predictions.join(broadcast_if_small(known), ["target", idx], "left")
        .withColumn(name, F.coalesce("_class", filler))
        .drop("_class")
    )


def remap_classes(train: DataFrame, column: str) -> DataFrame:
    """(old, new, n): the classes present in a training set, numbered without gaps."""
    counts = train.groupBy(F.col(column).alias("old")).agg(F.count("*").alias("n"))
    return index_within(counts, [], ["old"], "new").select("old", "new", "n")


def align_truth(truth: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("row_id", "target")) -> DataFrame:
    """Truth and prediction of the same row and target side by side."""
    return truth.join(predictions, list(keys), "inner")


def unseen_values(df: DataFrame, labels: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(target, value, n): values that are not among the fitted classes."""
    counts = long_values(df, present(df, targets), class_value).groupBy("target", "value").agg(
        F.count("*").alias("n")
    )
    known = labels.select("target", F.col("class").alias("value"))
    return counts.join(known, ["target", "value"], "left_anti")


def reduce_cardinality(df: DataFrame, column: str, n: int = TOP_COMMENTS, other: str = OTHER) -> DataFrame:
    """Keep the `n` most frequent values (ties: smaller value first), fold the rest."""
    top = most_frequent(df.select(F.lit(column).alias("target"), F.col(column).alias("value")), n)
    top = cut_lineage(top.select(F.col("value").alias("_kept")))
    value = F.when(F.col(column).isNull() | F.col("_kept").isNotNull(), F.col(column)).otherwise(other)
    return (
        df.join(broadcast_if_small(top), F.col(column) == F.col("_kept"), "left")
        .withColumn(column, value)
        .drop("_kept")
    )


def recent_training_runs(
    models: DataFrame, runs: DataFrame, user: int | str, limit: int = 10, per_model: int = 5
) -> DataFrame:
    """Newest runs of the user's newest models, newest first."""
    newest = (
        models.where(F.col("user_id") == F.lit(user))
        .orderBy(F.desc("created_at"), F.asc("model_id"))
        .limit(limit)
        .select("model_id")
    )
    place = F.row_number().over(
        Window.partitionBy("model_id").orderBy(F.desc("created_at"), F.asc("training_id"))
    )
    # At most `limit` models, so only their runs are shuffled and ranked.
    mine = runs.join(broadcast_if_small(newest), "model_id", "left_semi")
    return (
        mine.withColumn("_place", place)
        .where(F.col("_place") <= per_model)
        .drop("_place")
        .orderBy(F.desc("created_at"), F.asc("training_id"))
        .limit(limit)
    )


def run_for_model(models: DataFrame, runs: DataFrame, model_id: int | str) -> DataFrame:
    """The training runs that belong to a model."""
    wanted = models.where(F.col("model_id") == F.lit(model_id)).select("model_id")
    return runs.where(F.col("model_id") == F.lit(model_id)).join(wanted, "model_id", "left_semi")


def require_run(models: DataFrame, runs: DataFrame, model_id: int | str) -> DataFrame:
    found = run_for_model(models, runs, model_id)
    if found.isEmpty():
        raise LookupError(f"no training run for model {model_id!r}")
    return found
