"""Calendar and trend expressions over a DATE column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_CYCLE = 365.25
LAG_DAYS = 365
BASE_YEAR = 2012

CALENDAR_COLS = ["month", "day", "weekday", "dayofyear", "year", "quarter"]


def calendar_parts(date: str = "date") -> dict[str, Column]:
    """Integer date parts; weekday counts from Monday = 0."""
    return {
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "weekday": F.weekday(date),
        "dayofyear": F.dayofyear(date),
        "year": F.year(date),
        "quarter": F.quarter(date),
    }


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(calendar_parts(date))


def cyclic_parts(dayofyear: str = "dayofyear") -> dict[str, Column]:
    """Position in the year as a point on the unit circle."""
    angle = F.lit(2.0) * F.pi() * F.col(dayofyear) / F.lit(DAYS_PER_CYCLE)
    return {"day_sin": F.sin(angle), "day_cos": F.cos(angle)}


def days_since(start: Column, date: str = "date") -> Column:
    return F.datediff(F.col(date), start)


def trend_parts(
    days: str = "days_since_start", year: str = "year", base_year: int = BASE_YEAR
) -> dict[str, Column]:
    """Squared trend terms as BIGINT, so that long histories cannot overflow."""
    d = F.col(days).cast("long")
    y = (F.col(year) - F.lit(base_year)).cast("long")
    return {"days_since_start_sq": d * d, "year_sq": y * y}


def shift_days(date: str = "date", days: int = LAG_DAYS) -> Column:
    """A fixed number of days, not a calendar year: it slips after 29 February."""
    return F.date_add(F.col(date), days)
