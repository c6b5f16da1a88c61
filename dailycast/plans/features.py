"""Daily feature tables for a history and a horizon."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.functions.calendar import (
    BASE_YEAR,
    cyclic_parts,
    days_since,
    trend_parts,
    with_calendar,
)
from dailycast.operators import annual, growth, impute, lags, seasonal
from dailycast.operators.attach import attach_row, attach_stats
from dailycast.sources.staging import run_together, stage
from dailycast.sources.tables import Facts

# The names and the order of the feature columns.
FEATURE_COLS = [
    "hist_monthday_revenue_mean",
    "hist_monthday_cogs_mean",
    "hist_monthday_revenue_mean_2y",
    "hist_monthday_cogs_mean_2y",
    "hist_month_revenue_mean",
    "hist_month_cogs_mean",
    "hist_weekday_revenue_mean",
    "hist_weekday_cogs_mean",
    "lag_1y_revenue",
    "lag_1y_cogs",
    "day_cos",
    "hist_yoy_cogs_growth",
    "hist_yoy_cogs_growth_3y",
    "day_sin",
    "hist_yoy_revenue_growth",
    "hist_yoy_rev_growth_3y",
    "month",
    "year",
    "quarter",
    "days_since_start",
    "days_since_start_sq",
    "year_sq",
    "dayofyear",
    "weekday",
    "day",
]

# Derived from the date alone, hence never missing and never imputed.
DATE_COLS = {
    "day_cos",
    "day_sin",
    "month",
    "year",
    "quarter",
    "days_since_start",
    "days_since_start_sq",
    "year_sq",
    "dayofyear",
    "weekday",
    "day",
}


@dataclass(frozen=True)
class FeatureSet:
    """The three tables of the feature build and the feature column order."""

    train: DataFrame
    horizon: DataFrame
    target: DataFrame
    columns: list[str]


def add_calendar(
    rows: DataFrame, start: DataFrame, keys: Sequence[str] = (), base_year: int = BASE_YEAR
) -> DataFrame:
    """Calendar, cyclic and trend columns, counted from one training start."""
    rows = with_calendar(attach_row(rows, start, keys))
    rows = rows.withColumn("days_since_start", days_since(F.col("train_start")))
    return rows.withColumns({**cyclic_parts(), **trend_parts(base_year=base_year)}).drop(
        "train_start"
    )


def annual_columns(metrics: DataFrame | None, keys: Sequence[str] = ()) -> list[str]:
    return [] if metrics is None else [c for c in metrics.columns if c not in (*keys, "year")]


def build_features(
    sales: DataFrame,
    horizon: DataFrame,
    facts: Facts | None = None,
    keys: Sequence[str] = (),
    base_year: int = BASE_YEAR,
    staged: bool = True,
    stage_inputs: bool = True,
) -> FeatureSet:
    """Features for every date of ``sales`` and of ``horizon``.

    ``sales(keys…, date, revenue, cogs)`` and ``horizon(keys…, date)`` hold one
    row per date and series. Both run through one plan, told apart by a flag: with
    series keys it needs a single exchange of the daily rows, because every
    grouping, window and join in it is by series.

    With ``staged`` the daily rows, the annual metrics and the finished columns are
    each written once, since several branches read them and the facts behind them
    may be very large. ``stage_inputs=False`` says that ``sales`` and ``horizon``
    are cheap scans already.
    """
    keys = list(keys)
    spark = sales.sparkSession
    rows = sales.selectExpr(*keys, "date", "revenue", "cogs", "true as known").unionByName(
        horizon.selectExpr(
            *keys, "date", "double(null) as revenue", "double(null) as cogs", "false as known"
        )
    )
    rows = rows.filter(F.col("date").isNotNull())
    metrics = annual.annual_metrics(facts, keys) if facts else None
    if staged:
        work = {"rows": rows if stage_inputs else None, "annual": metrics}
        work = {n: df for n, df in work.items() if df is not None}
        done = run_together(spark, [lambda n=n, df=df: stage(df, n) for n, df in work.items()])
        rows = dict(zip(work, done)).get("rows", rows)
        metrics = dict(zip(work, done)).get("annual", metrics)
    if keys:
        rows = rows.repartition(*keys)
    sales = rows.filter("known").select(*keys, "date", "revenue", "cogs")

    start = seasonal.bounds(sales, keys).select(*keys, "train_start")
    full = add_calendar(rows, start, keys, base_year)
    full = seasonal.attach_seasonal(full, sales, keys)
    full = growth.attach_growth(full, growth.yoy_growth(sales, keys), "known", keys)
    if metrics is not None:
        years = full.filter("not known").select(*keys, "year").distinct()
        metrics = annual.extrapolate(metrics, years, keys)
        full = attach_stats(full, metrics, ["year"], keys)
    full = lags.lag_in_place(full, keys, "known") if keys else lags.attach_lag(full, sales)

    columns = FEATURE_COLS + annual_columns(metrics, keys)
    wanted = full.select(*keys, "date", "known", "revenue", "cogs", *columns)
    if staged:
        # The medians need the finished columns: compute those once, not twice.
        wanted = stage(wanted, "features")
    fillable = [c for c in columns if c not in DATE_COLS]
    past, ahead = wanted.filter("known"), wanted.filter("not known")
    train = lags.fill_history_lag(past).select(*keys, "date", *columns)
    test = lags.fill_horizon_lag(ahead).select(*keys, "date", *columns)
    return FeatureSet(
        train=impute.fill_own_median(train, fillable, keys),
        horizon=impute.fill_own_median(test, fillable, keys),
        target=past.select(*keys, "date", "revenue", "cogs"),
        columns=columns,
    )
