"""Exact linear-interpolated quantiles whose state stays bounded at any size."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
DISTINCT_LIMIT = 50_000


@dataclass(frozen=True)
class ColumnStats:
    """Statistics of one numeric column; nulls and NaN are left out."""

    rows: int
    low: float | None
    high: float | None
    quantiles: dict[float, float | None]


def as_double(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def column_quantiles(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    distinct_limit: int = DISTINCT_LIMIT,
    approximate: bool = False,
) -> dict[str, ColumnStats]:
    """Quantiles for several columns in few passes.

    Columns with few distinct values use `percentile`, whose state is one entry per
    distinct value. For the others an approximate sketch brackets the wanted ranks,
    exact counts confirm the bracket, and it is narrowed until few distinct values
    are left. Each pass is one aggregation for all open brackets.
    """
    if not probs:
        return {}
    columns = list(probs)
    first = df.agg(
        *[
            agg
            for i, c in enumerate(columns)
            for agg in (
                F.count(as_double(c)).alias(f"n{i}"),
                F.approx_count_distinct(as_double(c)).alias(f"d{i}"),
                F.min(as_double(c)).alias(f"lo{i}"),
                F.max(as_double(c)).alias(f"hi{i}"),
            )
        ]
    ).first()
    found: dict[str, dict[float, float | None]] = {c: {} for c in columns}
    simple, brackets = [], []
    for i, c in enumerate(columns):
        n = first[f"n{i}"]
        if n == 0:
            found[c] = {p: None for p in probs[c]}
        elif approximate or first[f"d{i}"] <= distinct_limit:
            simple.append(c)
        else:
            brackets += [
                _Bracket.start(c, p, n, first[f"lo{i}"], first[f"hi{i}"]) for p in probs[c]
            ]
    if simple:
        def quantile(c: str) -> Column:
            wanted = F.array(*[F.lit(float(p)) for p in probs[c]])
            if approximate:
                return F.percentile_approx(as_double(c), wanted, ACCURACY)
            return F.percentile(as_double(c), wanted)

        row = df.agg(*[quantile(c).alias(f"q{i}") for i, c in enumerate(simple)]).first()
        for i, c in enumerate(simple):
            found[c] = dict(zip(probs[c], row[f"q{i}"]))
    open_ones = brackets
    while open_ones:
        open_ones = _narrow(df, open_ones, distinct_limit)
    for b, value in zip(brackets, _finish(df, brackets)):
        found[b.column][b.prob] = value
    return {
        c: ColumnStats(first[f"n{i}"], first[f"lo{i}"], first[f"hi{i}"], found[c])
        for i, c in enumerate(columns)
    }


@dataclass
class _Bracket:
    """Closed value range known to hold the two order statistics of one quantile."""

    column: str
    prob: float
    rank: int
    next_rank: int
    share: float
    low: float
    high: float
    below: int
    inside: int
    slack: float = 2.0 / ACCURACY

    @classmethod
    def start(cls, column: str, prob: float, n: int, low: float, high: float) -> "_Bracket":
        place = prob * (n - 1)
        rank = math.floor(place)
        return cls(column, prob, rank, min(math.ceil(place), n - 1), place - rank, low, high, 0, n)

    def member(self, low: float, high: float) -> Column:
        value = as_double(self.column)
        return (value >= F.lit(low)) & (value <= F.lit(high))


def _narrow(df: DataFrame, brackets: list[_Bracket], distinct_limit: int) -> list[_Bracket]:
    guesses = df.agg(
        *[
            F.percentile_approx(
                F.when(b.member(b.low, b.high), as_double(b.column)),
                F.array(
                    F.lit(max(0.0, (b.rank - b.below) / b.inside - b.slack)),
                    F.lit(min(1.0, (b.next_rank - b.below + 1) / b.inside + b.slack)),
                ),
                ACCURACY,
            ).alias(f"g{i}")
            for i, b in enumerate(brackets)
        ]
    ).first()
    counts = df.agg(
        *[
            agg
            for i, b in enumerate(brackets)
            for agg in (
                F.count_if(as_double(b.column) < F.lit(guesses[i][0])).alias(f"b{i}"),
                F.count_if(b.member(*guesses[i])).alias(f"n{i}"),
                F.count_if(as_double(b.column) == F.lit(guesses[i][0])).alias(f"first{i}"),
                F.count_if(as_double(b.column) == F.lit(guesses[i][1])).alias(f"last{i}"),
                F.min(
                    F.when(as_double(b.column) > F.lit(guesses[i][0]), as_double(b.column))
                ).alias(f"after{i}"),
                F.max(
                    F.when(as_double(b.column) < F.lit(guesses[i][1]), as_double(b.column))
                ).alias(f"before{i}"),
                F.approx_count_distinct(
                    F.when(b.member(*guesses[i]), as_double(b.column))
                ).alias(f"d{i}"),
            )
        ]
    ).first()
    still_open = []
    for i, b in enumerate(brackets):
        below, inside = counts[f"b{i}"], counts[f"n{i}"]
        if not (below <= b.rank and b.next_rank < below + inside):
            b.slack *= 4
            still_open.append(b)
            continue
        low, high = guesses[i]
        after_low = below + counts[f"first{i}"]
        from_high = below + inside - counts[f"last{i}"]
        if b.next_rank < after_low:
            b.low = b.high = low
        elif b.rank >= from_high:
            b.low = b.high = high
        elif b.rank < after_low:
            b.low, b.high = low, counts[f"after{i}"]
        elif b.next_rank >= from_high:
            b.low, b.high = counts[f"before{i}"], high
        else:
            # Both ranks lie between the ends, however many rows the ends hold.
            b.low, b.high = counts[f"after{i}"], counts[f"before{i}"]
            b.below, b.inside = after_low, from_high - after_low
            if counts[f"d{i}"] > distinct_limit:
                still_open.append(b)
    return still_open


def _finish(df: DataFrame, brackets: list[_Bracket]) -> list[float]:
    """Read the few distinct values of all narrowed brackets in one pass and pick the ranks.

    A row gives each bracket its value, or null where it lies below; rows above are left out.
    """
    if not brackets:
        return []
    cells = [
        F.struct(
            F.lit(i).alias("i"), F.when(as_double(b.column) >= F.lit(b.low), as_double(b.column)).alias("v"),
            (as_double(b.column) <= F.lit(b.high)).alias("reached"),
        )
        for i, b in enumerate(brackets)
    ]
    counts = df.select(F.inline(F.array(*cells))).where("reached").groupBy("i", "v").count().collect()
    picked = []
    for i, b in enumerate(brackets):
        seen = sum(r["count"] for r in counts if r["i"] == i and r["v"] is None)
        ends = {}
        for v, n in sorted((r["v"], r["count"]) for r in counts if r["i"] == i and r["v"] is not None):
            for rank in (b.rank, b.next_rank):
                if seen <= rank < seen + n:
                    ends[rank] = v
            seen += n
        picked.append(ends[b.rank] + (ends[b.next_rank] - ends[b.rank]) * b.share)
    return picked
