"""The list of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    """One query: what it covers, how Spark runs it, and the SQL that should agree."""

    name: str
    covers: str
    run: Run
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name; `covers` lists blueprint ids."""

    def register(run: Run) -> Run:
        ENTRIES[run.__name__] = Entry(run.__name__, covers, run, sql)
        return run

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of decimals, as sums of doubles depend on their order."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
