"""Date columns: relative dates, stand-in dates and month periods."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedbackmill.functions.text import strip
from feedbackmill.schemas import UNKNOWN

# Units of a relative date and their days, in the order they are tested.
UNIT_DAYS = (("year", 365), ("month", 30), ("week", 7), ("day", 1))

# Date forms read besides ISO dates and times.
DAY_FORMS = ("M/d/yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "M-d-yyyy[ H:mm[:ss]]") + tuple(
    form for month in ("MMM", "MMMM") for form in (
        f"{month} d[,] yyyy", f"d {month}[,] yyyy", f"{month}-d-yyyy", f"d-{month}-yyyy", f"{month}/d/yyyy", f"d/{month}/yyyy",
    )
)


def normalize_date(text: Column, as_of: Column) -> Column:
    """ISO date for relative wording, the lower-cased text for absolute dates, or ``Unknown``."""
    value = strip(F.lower(F.coalesce(text, F.lit(""))))
    absolute = F.contains(value, F.lit("-")) | F.contains(value, F.lit("/"))
    unit = F.lit(None).cast("long")
    for word, days in reversed(UNIT_DAYS):
        unit = F.when(F.contains(value, F.lit(word)), F.lit(days).cast("long")).otherwise(unit)
    digits = F.regexp_replace(value, "[^0-9]", "")
    article = F.contains(value, F.lit("a ")) | F.contains(value, F.lit("an "))
    count = F.when(article | (digits == ""), F.lit(1).cast("long")).otherwise(digits.try_cast("long"))
    back = F.try_multiply(count, unit)
    # A count that leaves the calendar falls back to today, as an unreadable text does.
    in_calendar = back <= F.datediff(as_of, F.lit("0001-01-01").cast("date"))
    days = F.when(in_calendar, back).otherwise(F.lit(0)).cast("int")
    return (
        F.when(value.isin("", UNKNOWN.lower()), F.lit(UNKNOWN))
        .when(absolute, value)
        .otherwise(F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd"))
    )


def fill_unknown_date(date: Column, position: Column, as_of: Column) -> Column:
    """Stand-in for ``Unknown``: the row at position i gets the day i days before ``as_of``.

    Positions that leave the calendar (before year 1) get ``as_of`` itself, as far relative dates do.
    """
    in_calendar = position <= F.datediff(as_of, F.lit("0001-01-01").cast("date"))
    days = F.when(in_calendar, position).otherwise(F.lit(0)).cast("int")
    stand_in = F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd")
    return F.when(date == UNKNOWN, stand_in).otherwise(date)


def review_day(date: Column) -> Column:
    """Timestamp of the date forms that dashboards can read, else null."""
    return F.coalesce(
        F.try_to_date(date, "yyyy-MM-dd").cast("timestamp"),
        F.upper(date).try_cast("timestamp"),
        *[F.try_to_timestamp(date, F.lit(form)) for form in DAY_FORMS],
    )


def month_period(date: Column) -> Column:
    return F.coalesce(F.date_format(review_day(date), "yyyy-MM"), F.lit(UNKNOWN))
