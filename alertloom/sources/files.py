"""CSV in, CSV splits out, metrics as JSON, reports as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.spec import CSV_NULLS, flat


_WRITE_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def flatten_names(df: DataFrame) -> DataFrame:
    """Dots in column names become `__`."""
    return df.toDF(*[flat(c) for c in df.columns])


def dotted_names(df: DataFrame) -> DataFrame:
    """The inverse of `flatten_names`, for sinks."""
    return df.toDF(*[c.replace("__", ".") for c in df.columns])


def read_alerts_csv(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Header CSV as strings, with the usual null spellings as null.

    `columns` names the fields in file order and saves the pass over the header.
    Quoted line breaks make a file unsplittable: many files still spread over the
    cluster, and `multi_line=False` also splits large files that have none.
    """
    reader = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", columns is not None)
    )
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    paths = path if isinstance(path, str) else list(path)
    raw = flatten_names(reader.csv(paths))
    return raw.select(
        *[F.when(~F.col(c).isin(*CSV_NULLS), F.col(c)).alias(c) for c in raw.columns]
    )


def write_alerts_csv(df: DataFrame, path: str) -> None:
    """Header CSV with dotted names, doubled quotes and values as they are."""
    dotted_names(df).write.mode("errorifexists").options(**_WRITE_OPTIONS).csv(path)


def write_splits(labelled: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split below `path`, each header CSV; unlabelled rows are left out."""
    (
        dotted_names(labelled.where(F.col(split).isNotNull()))
        .write.mode("errorifexists")
        .partitionBy(split)
        .options(**_WRITE_OPTIONS)
        .csv(path)
    )


def read_split(spark: SparkSession, path: str, part: str, split: str = "split") -> DataFrame:
    return read_alerts_csv(spark, f"{path.rstrip('/')}/{split}={part}")


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("errorifexists").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").text(path)
