"""Number parsing that rejects what is not wholly a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions.text import strip
from alertloom.spec import NULL_WORDS

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse(value: Column) -> Column:
    """Double, or null when the string is not a number (`12d`, `1,000`, `abc`)."""
    stripped = strip(value.cast("string"))
    return F.when(stripped.rlike(NUMBER_PATTERN), stripped.try_cast("double"))


def coerce(value: Column, data_type: T.DataType | None = None) -> Column:
    """Number with null, blank, null words and unparsable values as 0.

    Integral columns keep their type, other numeric ones become double.
    """
    if isinstance(data_type, T.IntegralType):
        return F.coalesce(value, F.lit(0).cast(data_type))
    if isinstance(data_type, T.NumericType):
        return F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    text = value.cast("string")
    number = F.when(text.isin("", *NULL_WORDS), F.lit(0.0)).otherwise(parse(text))
    return F.coalesce(number, F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
