"""Text expressions: stripping, null words, title case, words and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.spec import NO_WORDS, NULL_WORDS, STRIP_CHARS, UNKNOWN_WORDS, YES_WORDS

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_WHITE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(STRIP_CHARS))


def clean_text(value: Column) -> Column:
    """String, stripped; null and null words become the empty string."""
    stripped = F.coalesce(strip(value.cast("string")), F.lit(""))
    return F.when(stripped.isin(*NULL_WORDS), F.lit("")).otherwise(stripped)


def title_case(value: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others.

    Values of plain letters and spaces take the `initcap` path, where both agree.
    """
    pieces = F.regexp_extract_all(
        F.lower(value), F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1)
    )
    general = F.array_join(
        F.transform(
            pieces, lambda p: F.concat(F.upper(p.substr(1, 1)), p.substr(F.lit(2), F.length(p)))
        ),
        "",
    )
    return F.when(value.rlike("^[A-Za-z ]*$"), F.initcap(value)).otherwise(general)


def titled(value: Column, null_token: str = "Nan") -> Column:
    """Stripped and title-cased string of a category."""
    return title_case(strip(F.coalesce(value.cast("string"), F.lit(null_token))))


def unified(value: Column) -> Column:
    """Spellings of yes, no and unknown brought together, for a title-cased category."""
    return (
        F.when(value.isin(*YES_WORDS), F.lit("YES"))
        .when(value.isin(*NO_WORDS), F.lit("NO"))
        .when(value.isin(*UNKNOWN_WORDS), F.lit("Unknown"))
        .otherwise(value)
    )


def words(value: Column) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(value, F.lit(f"[^{_WHITE}]+"), F.lit(0))


def unigrams(value: Column) -> Column:
    """Lower-cased word tokens of two or more characters."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(value, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0)
    )


def ngrams(tokens: Column, sizes: tuple[int, int]) -> Column:
    """All n-grams of a token array for n from sizes[0] to sizes[1], words joined by a space."""
    low, high = sizes
    grams = [tokens if n == 1 else _ngrams(tokens, n) for n in range(low, high + 1)]
    return grams[0] if len(grams) == 1 else F.concat(*grams)


def _ngrams(tokens: Column, n: int) -> Column:
    count = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    joined = F.slice(tokens, 1, count)
    for k in range(1, n):
        joined = F.zip_with(
            joined, F.slice(tokens, k + 1, count), lambda a, b: F.concat_ws(" ", a, b)
        )
    return joined
