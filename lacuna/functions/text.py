"""Checks and casts for columns that arrive as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text forms that count as a number and as a whole number.
NUMERIC_PATTERN = r"[-+]?\d+(\.\d+)?"
WHOLE_PATTERN = r"[-+]?\d+"


def _whole_text_matches(column: Column, pattern: str) -> Column:
    # \z and not $: with $ a value ending in a line break would pass.
    return column.rlike(f"^{pattern}\\z")


def is_number(column: Column, data_type: T.DataType | None = None) -> Column:
    """True where the value is usable as a feature; null values are not.

    Text must match ``NUMERIC_PATTERN`` in full and fit a double: hundreds of
    digits would be read as infinity. A column that is already
    numeric is checked for NaN and infinity instead of being printed and
    matched, which would refuse values that print with an exponent.
    """
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        value = column.cast("double")
        finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        return column.isNotNull() & finite
    if isinstance(data_type, T.NumericType):
        return column.isNotNull()
    text = column.cast("string")
    finite = F.abs(text.try_cast("double")) != F.lit(float("inf"))
    return text.isNotNull() & _whole_text_matches(text, NUMERIC_PATTERN) & finite


def to_text(column: Column) -> Column:
    """Null-safe text form."""
    return column.cast("string")


def to_double(column: Column) -> Column:
    """Number from text; null for null and for text that is no number."""
    return column.try_cast("double")


def to_long(column: Column) -> Column:
    """Whole number from text; null for anything else, such as ``1e5``."""
    text = column.cast("string")
    return F.when(_whole_text_matches(text, WHOLE_PATTERN), text.try_cast("bigint"))
