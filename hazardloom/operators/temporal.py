"""Date and time features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import dates
from ..functions.values import to_double


def to_number(df: DataFrame, cols: list[str]) -> DataFrame:
    """Listed columns as doubles; unreadable text becomes null."""
    return df.withColumns({c: to_double(c) for c in cols if c in df.columns})


def accident_date(df: DataFrame, year: str, month: str, out: str = "accident_date") -> DataFrame:
    return df.withColumn(out, dates.accident_date(year, month))


def date_parts(df: DataFrame, col: str = "accident_date", prefix: str = "accident") -> DataFrame:
    """Year, month, quarter, day of year, weekday (Monday 0) and its name."""
    d = F.col(col)
    return df.withColumns(
        {
            f"{prefix}_year": F.year(d),
            f"{prefix}_month": F.month(d),
            f"{prefix}_quarter": F.quarter(d),
            f"{prefix}_day_of_year": F.dayofyear(d),
            f"{prefix}_weekday": F.weekday(d),
            f"{prefix}_weekday_name": dates.day_name(d),
        }
    )


def time_parts(df: DataFrame, col: str) -> DataFrame:
    """Parsed time, hour, minute and part of day; the last three only if any value parses."""
    parsed = dates.parse_clock(col)
    out = df.withColumn(f"{col}_parsed", parsed)
    if df.where(parsed.isNotNull()).isEmpty():
        return out
    hour = F.hour(parsed)
    return out.withColumns(
        {
            f"{col}_hour": hour,
            f"{col}_minute": F.minute(parsed),
            f"{col}_time_of_day": dates.part_of_day(hour),
        }
    )


def convert_date_columns(
    df: DataFrame,
    year: str = "Accident Year",
    month: str = "Accident Month",
    day: str | None = None,
    date: str | None = None,
) -> DataFrame:
    """Numbers, accident date, its parts, the existing date column and the time column in one call."""
    out = to_number(df, [c for c in (year, month, day) if c])
    if year in df.columns and month in df.columns:
        out = date_parts(accident_date(out, year, month))
    if date and date in df.columns:
        out = out.withColumn(date, dates.parse_date(date))
    for col in ("Time", "time", "TIME"):
        if col in df.columns:
            out = time_parts(out, col)
    return out


def normalize_dates(df: DataFrame, col: str, formats: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Dates in any accepted layout as ``yyyy-MM-dd`` text."""
    return df.withColumn(out or col, F.date_format(dates.parse_date(col, formats), "yyyy-MM-dd"))


def date_features(df: DataFrame, col: str = "accident_date") -> DataFrame:
    """Ten calendar features named ``<col>_…``; a missing column leaves the table unchanged."""
    if col not in df.columns:
        return df
    if not isinstance(df.schema[col].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn(col, dates.parse_date(col))
    d = F.col(col)
    return df.withColumns(
        {
            f"{col}_year": F.year(d),
            f"{col}_month": F.month(d),
            f"{col}_day": F.dayofmonth(d),
            f"{col}_quarter": F.quarter(d),
            f"{col}_weekday": F.weekday(d),
            f"{col}_weekday_name": dates.day_name(d),
            f"{col}_is_weekend": F.coalesce(F.weekday(d) >= 5, F.lit(False)),
            f"{col}_day_of_year": F.dayofyear(d),
            f"{col}_week_of_year": F.weekofyear(d),
            f"{col}_season": dates.season(d),
        }
    )


def time_features(df: DataFrame, col: str) -> DataFrame:
    """year, month, day, dayofweek, quarter; unreadable dates are an error."""
    if col not in df.columns:
        return df
    df = df.withColumn(col, F.col(col).cast("timestamp"))
    d = F.col(col)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day": F.dayofmonth(d),
            "dayofweek": F.weekday(d),
            "quarter": F.quarter(d),
        }
    )
