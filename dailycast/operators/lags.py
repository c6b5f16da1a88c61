"""One-year lag by date, and what stands in where it is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.functions.calendar import LAG_DAYS, shift_days


def lag_table(
    sales: DataFrame, keys: Sequence[str] = (), days: int = LAG_DAYS
) -> DataFrame:
    """The history moved forward, keyed by the date it is a lag for."""
    return sales.select(
        *keys,
        shift_days("date", days).alias("date"),
        F.col("revenue").alias("lag_1y_revenue"),
        F.col("cogs").alias("lag_1y_cogs"),
    )


def attach_lag(
    rows: DataFrame, sales: DataFrame, keys: Sequence[str] = (), days: int = LAG_DAYS
) -> DataFrame:
    """Join rather than shift by rows, so that gaps in the dates stay gaps."""
    return rows.join(lag_table(sales, keys, days), [*keys, "date"], "left")


def lag_in_place(
    rows: DataFrame, keys: Sequence[str], known: str, days: int = LAG_DAYS
) -> DataFrame:
    """The same lag where ``rows`` hold the history itself, flagged by ``known``.

    A range frame on the day number looks back exactly ``days`` days. It runs in
    the partitioning by series that the rows already have, one series at a time.
    """
    series = ", ".join(keys)
    frame = (
        f"over (partition by {series} order by unix_date(date) "
        f"range between {days} preceding and {days} preceding)"
    )
    return rows.selectExpr(
        "*",
        *[f"max(if({known}, {m}, null)) {frame} as lag_1y_{m}" for m in ("revenue", "cogs")],
    )


def fill_history_lag(rows: DataFrame) -> DataFrame:
    """Each lag falls back on its own full-history month-day mean."""
    return rows.withColumns(
        {
            f"lag_1y_{m}": F.coalesce(f"lag_1y_{m}", f"hist_monthday_{m}_mean")
            for m in ("revenue", "cogs")
        }
    )


def fill_horizon_lag(rows: DataFrame) -> DataFrame:
    """A missing revenue lag sends both lags to the recent month-day means."""
    missing = F.col("lag_1y_revenue").isNull()
    return rows.withColumns(
        {
            f"lag_1y_{m}": F.when(missing, F.col(f"hist_monthday_{m}_mean_2y")).otherwise(
                F.col(f"lag_1y_{m}")
            )
            for m in ("revenue", "cogs")
        }
    )
