"""Rating columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the decimal number form that is read as a rating.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_rating(text: Column) -> Column:
    """Number in ``text``; anything else, not-a-number and infinities included, is 0."""
    value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    finite = F.when(F.abs(value) < F.lit(float("inf")), value)
    return F.coalesce(finite, F.lit(0.0))


def first_number(text: Column) -> Column:
    """Rating in the first word of a label such as ``4.0 stars``."""
    return parse_rating(F.regexp_extract(text, r"(\S+)", 1))


def rating_or_zero(rating: Column) -> Column:
    return F.coalesce(F.nanvl(rating, F.lit(0.0)), F.lit(0.0))


def rating_bucket(rating: Column) -> Column:
    """Half-up whole rating, with 0 counted as 1; callers keep 1 to 5."""
    rounded = F.floor(rating_or_zero(rating) + F.lit(0.5))
    return F.when(rounded == 0, F.lit(1)).otherwise(rounded).cast("long")


def half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("long")


def two_decimals(value: Column) -> Column:
    """Text form for output; results keep the raw double."""
    return F.format_string("%.2f", value)
