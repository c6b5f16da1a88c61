"""Year-over-year growth of the annual totals.

The windows here run at year grain, tens of rows per series, after the daily
rows have been aggregated; with series keys they are partitioned by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailycast.functions.numeric import money_sum, ratio
from dailycast.operators.attach import attach_row, attach_stats

ROLLING_YEARS = 3

GROWTH_COLS = [
    "hist_yoy_revenue_growth",
    "hist_yoy_cogs_growth",
    "hist_yoy_rev_growth_3y",
    "hist_yoy_cogs_growth_3y",
]


def _by_year(keys: Sequence[str]) -> str:
    parts = f"partition by {', '.join(keys)} " if keys else ""
    return f"{parts}order by year"


def row_growth(x: str, keys: Sequence[str] = ()) -> Column:
    """Change against the previous row: across a missing year it spans the gap."""
    return ratio(x, f"lag({x}) over ({_by_year(keys)})") - 1


def rolling_mean(x: str, keys: Sequence[str] = (), rows: int = ROLLING_YEARS) -> Column:
    """Mean of the finite values among the last ``rows`` rows, NULL if none."""
    frame = f"rows between {rows - 1} preceding and current row"
    finite = f"if(abs({x}) < double('inf'), {x}, null)"
    return F.expr(f"avg({finite}) over ({_by_year(keys)} {frame})")


def annual_totals(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sales.groupBy(*keys, F.year("date").alias("year")).agg(
        money_sum("revenue").alias("revenue"), money_sum("cogs").alias("cogs")
    )


def yoy_growth(sales: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Year, totals, row-to-row growth and its three-row mean."""
    totals = annual_totals(sales, keys)
    single = totals.withColumns(
        {
            "hist_yoy_revenue_growth": row_growth("revenue", keys),
            "hist_yoy_cogs_growth": row_growth("cogs", keys),
        }
    )
    return single.withColumns(
        {
            "hist_yoy_rev_growth_3y": rolling_mean("hist_yoy_revenue_growth", keys),
            "hist_yoy_cogs_growth_3y": rolling_mean("hist_yoy_cogs_growth", keys),
        }
    )


def latest_growth(growth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The growth figures of the last year present, NULLs included."""
    return growth.groupBy(*keys).agg(*[F.max_by(c, "year").alias(c) for c in GROWTH_COLS])


def attach_growth(
    rows: DataFrame, growth: DataFrame, known: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Known rows get their own year's growth, later ones the latest figures."""
    own = growth.select(*keys, "year", *GROWTH_COLS)
    last = latest_growth(growth, keys).withColumnsRenamed({c: f"_last_{c}" for c in GROWTH_COLS})
    both = attach_row(attach_stats(rows, own, ["year"], keys), last, keys)
    return both.selectExpr(
        *rows.columns, *[f"if({known}, {c}, _last_{c}) as {c}" for c in GROWTH_COLS]
    )
