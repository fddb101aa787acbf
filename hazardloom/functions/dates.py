"""Date and time functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import as_column, to_double

# Accepted date layouts, tried in this order.
DATE_LAYOUTS = [
    "yyyy-M-d",
    "yyyy-M",
    "M/d/yyyy",
    "M-d-yyyy",
    "yyyy/M/d",
    "d/M/yyyy",
    "yyyy",
    "yyyy-M-d H:m:s",
]

# Season of each month, January first.
SEASONS = ["Winter", "Winter", "Spring", "Spring", "Spring", "Summer",
           "Summer", "Summer", "Fall", "Fall", "Fall", "Winter"]


def accident_date(year, month) -> Column:
    """First day of the month; 1 January when the month is missing; null without a year."""
    y = to_double(year).try_cast("int")
    m = F.coalesce(to_double(month).try_cast("int"), F.lit(1))
    return F.try_to_timestamp(F.format_string("%04d-%02d-01", y, m), F.lit("yyyy-MM-dd")).cast("date")


def parse_date(c, layouts: list[str] | None = None) -> Column:
    """First layout that fits, else whatever the timestamp cast understands, else null."""
    s = F.trim(as_column(c).cast("string"))
    tries = [F.try_to_timestamp(s, F.lit(p)) for p in (layouts or DATE_LAYOUTS)]
    return F.coalesce(*tries, s.try_cast("timestamp"))


def day_name(d) -> Column:
    return F.date_format(as_column(d), "EEEE")


def season(d) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), F.month(as_column(d)))


def parse_clock(c) -> Column:
    """``H:mm`` text as a timestamp on 1970-01-01; null when unreadable."""
    return F.try_to_timestamp(F.trim(as_column(c).cast("string")), F.lit("H:m"))


def part_of_day(hour) -> Column:
    """Missing hours fall into 'Night' because no comparison holds for them."""
    h = as_column(hour)
    return (
        F.when((h >= 6) & (h < 12), "Morning")
        .when((h >= 12) & (h < 18), "Afternoon")
        .when((h >= 18) & (h < 22), "Evening")
        .otherwise("Night")
    )
