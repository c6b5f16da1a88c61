"""Seasonal baselines: means of the history per calendar slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.functions.calendar import with_calendar
from dailycast.functions.numeric import money_mean
from dailycast.operators.attach import attach_row, attach_stats

RECENT_YEARS = 2


def bounds(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last date and last year of the history."""
    return sales.groupBy(*keys).agg(
        F.min("date").alias("train_start"),
        F.max("date").alias("train_end"),
        F.max(F.year("date")).alias("max_year"),
    )


def recent(sales: DataFrame, keys: Sequence[str] = (), years: int = RECENT_YEARS) -> DataFrame:
    """Rows of the last ``years`` calendar years of the history."""
    last = bounds(sales, keys).select(*keys, "max_year")
    return (
        attach_row(sales, last, keys)
        .filter(F.year("date") > F.col("max_year") - F.lit(years))
        .drop("max_year")
    )


def _means(slot: str, suffix: str = "", when: str | None = None):
    return [
        money_mean(f"if({when}, {m}, null)" if when else m).alias(
            f"hist_{slot}_{m}_mean{suffix}"
        )
        for m in ("revenue", "cogs")
    ]


def monthday_means(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    df = sales.withColumns({"month": F.month("date"), "day": F.dayofmonth("date")})
    return df.groupBy(*keys, "month", "day").agg(*_means("monthday"))


def monthday_means_recent(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    df = recent(sales, keys).withColumns({"month": F.month("date"), "day": F.dayofmonth("date")})
    return df.groupBy(*keys, "month", "day").agg(*_means("monthday", "_2y"))


def monthday_means_both(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Full-history and recent means from one pass over the history."""
    last = bounds(sales, keys).select(*keys, "max_year")
    df = with_calendar(attach_row(sales, last, keys))
    is_recent = f"year > max_year - {RECENT_YEARS}"
    return df.groupBy(*keys, "month", "day").agg(
        *_means("monthday"), *_means("monthday", "_2y", is_recent)
    )


def month_means(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sales.groupBy(*keys, F.month("date").alias("month")).agg(*_means("month"))


def weekday_means(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sales.groupBy(*keys, F.weekday("date").alias("weekday")).agg(
        *_means("weekday")
    )


def attach_seasonal(
    rows: DataFrame,
    sales: DataFrame,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add the eight seasonal means to rows that carry the calendar columns."""
    rows = attach_stats(rows, monthday_means_both(sales, keys), ["month", "day"], keys)
    rows = attach_stats(rows, month_means(sales, keys), ["month"], keys)
    return attach_stats(rows, weekday_means(sales, keys), ["weekday"], keys)
