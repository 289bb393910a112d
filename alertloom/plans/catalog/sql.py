"""SQL fragments of the counterparts, written for DuckDB and independent of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from alertloom.plans.alerts import ALERTS_SQL, COLUMNS
from alertloom.spec import STRIP_CHARS

NULLISH = "('nan', 'NaN', 'null', 'NULL', 'None')"
SPACES = f"'{STRIP_CHARS}'"

TEXTS = [
    "hit__matching_text", "hit__watchlist_text", "mt103__sanction_list",
    "hit__review_comments", "decision__reviewer_comments",
]
CATEGORIES = [
    "hit__is_pep", "hit__hit_type", "hit__matching_type", "hit__priority", "hit__severity",
    "hit__country", "hit__mt_type", "hit__review_decision", "decision__last_action",
]
NUMBERS = [
    "hit__score", "hit__fuzzy_match_score", "mt202__amount", "mt103__hits_count_103",
    "mt202__hits_count_202", "mt202__charges",
]
OTHERS = [c for c in COLUMNS if c not in TEXTS + CATEGORIES + NUMBERS]


def strip(x: str) -> str:
    return f"trim(CAST({x} AS VARCHAR), {SPACES})"


def clean_text(x: str) -> str:
    value = f"coalesce({strip(x)}, '')"
    return f"CASE WHEN {value} IN {NULLISH} THEN '' ELSE {value} END"


def title(x: str) -> str:
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return (
        f"coalesce(list_aggregate(list_transform(regexp_extract_all(lower({x}), "
        f"'([{cased}]+|[^{cased}]+)', 1), "
        "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ''), '')"
    )


def category(x: str, null_token: str = "Nan") -> str:
    titled = title(strip(f"coalesce(CAST({x} AS VARCHAR), '{null_token}')"))
    return (
        f"CASE WHEN {titled} IN ('Yes', 'True', 'Y', '1') THEN 'YES' "
        f"WHEN {titled} IN ('No', 'False', 'N', '0') THEN 'NO' "
        f"WHEN {titled} IN ('nan', 'NaN', 'null', 'NULL') THEN 'Unknown' ELSE {titled} END"
    )


def parsed(x: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({strip(x)}, "
        r"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') "
        f"THEN TRY_CAST({strip(x)} AS DOUBLE) END"
    )


def number(x: str) -> str:
    return (
        f"CASE WHEN CAST({x} AS VARCHAR) IN ('', 'nan', 'NaN', 'null', 'NULL', 'None') THEN 0 "
        f"ELSE coalesce({parsed(x)}, 0) END"
    )


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"


def bigrams(t: str) -> str:
    return f"list_transform(generate_series(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def terms(x: str) -> str:
    return f"list_concat({tokens(x)}, {bigrams(tokens(x))})"


def with_ctes(ctes: Sequence[tuple[str, str]], final: str) -> str:
    body = ", ".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH {body} {final}"


ALERTS = ("alerts", ALERTS_SQL)


def role_columns(numbers_as: str = "number") -> list[str]:
    made = [f"{clean_text(c)} AS {c}" for c in TEXTS]
    made += [f"{category(c)} AS {c}" for c in CATEGORIES]
    made += [f"CAST({number(c)} AS DOUBLE) AS {c}" for c in NUMBERS]
    return made


# Roles applied to the alert table; numbers coerced, not yet clipped.
CLEANED = ("cleaned", "SELECT " + ", ".join(OTHERS + role_columns()) + " FROM alerts")


def fences(source: str, columns: Sequence[str]) -> tuple[str, str]:
    parts = [
        f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3, "
        f"count(DISTINCT {c}) AS {c}_d"
        for c in columns
    ]
    return ("fences", f"SELECT {', '.join(parts)} FROM {source}")


def clipped(c: str) -> str:
    q1, q3 = f"{c}_q1", f"{c}_q3"
    low, high = f"({q1} - 1.5 * ({q3} - {q1}))", f"({q3} + 1.5 * ({q3} - {q1}))"
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN {c}_d > 1 AND {q3} - {q1} > 0 "
        f"THEN least(greatest(CAST({c} AS DOUBLE), {low}), {high}) ELSE {c} END"
    )


def fixed(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


# The cleaned table with clipped numbers.
CLIPPED = [
    ALERTS,
    CLEANED,
    fences("cleaned", NUMBERS),
    (
        "clipped",
        "SELECT "
        + ", ".join(
            [f"cleaned.{c}" for c in OTHERS + TEXTS + CATEGORIES]
            + [f"{clipped(c)} AS {c}" for c in NUMBERS]
        )
        + " FROM cleaned CROSS JOIN fences",
    ),
]
