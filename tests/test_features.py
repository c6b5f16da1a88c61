"""The feature build against a row-by-row restatement, and its edge cases."""

import datetime as dt
import math
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from dailycast.operators import growth, impute, lags, seasonal
from dailycast.plans.features import build_features
from dailycast.sources.tables import Facts

D = dt.date
SALES = "date date, revenue double, cogs double"


def days(first, last):
    return [first + dt.timedelta(n) for n in range((last - first).days + 1)]


def make_sales(seed=1, first=D(1996, 1, 1), last=D(1999, 12, 31), keep=0.9):
    rng = random.Random(seed)
    return [
        (d, round(rng.uniform(50, 500), 2), round(rng.uniform(10, 100), 2))
        for d in days(first, last)
        if rng.random() < keep
    ]


def brute_row(d, history, horizon):
    """Features of one date, straight from their definitions."""
    out = {}
    by_date = {r[0]: r for r in history}
    last_year = max(r[0].year for r in history)
    for i, m in ((1, "revenue"), (2, "cogs")):
        def mean(rows):
            return sum(r[i] for r in rows) / len(rows) if rows else None

        same_day = [r for r in history if (r[0].month, r[0].day) == (d.month, d.day)]
        out[f"hist_monthday_{m}_mean"] = mean(same_day)
        out[f"hist_monthday_{m}_mean_2y"] = mean([r for r in same_day if r[0].year >= last_year - 1])
        out[f"hist_month_{m}_mean"] = mean([r for r in history if r[0].month == d.month])
        out[f"hist_weekday_{m}_mean"] = mean([r for r in history if r[0].weekday() == d.weekday()])
        years = sorted({r[0].year for r in history})
        total = [sum(r[i] for r in history if r[0].year == y) for y in years]
        grow = [None] + [b / a - 1 for a, b in zip(total, total[1:])]
        at = len(years) - 1 if horizon else years.index(d.year)
        out[f"hist_yoy_{m}_growth"] = grow[at]
        recent = [g for g in grow[max(0, at - 2): at + 1] if g is not None]
        short = "rev" if m == "revenue" else "cogs"
        out[f"hist_yoy_{short}_growth_3y"] = sum(recent) / len(recent) if recent else None
    earlier = by_date.get(d - dt.timedelta(365))
    for i, m in ((1, "revenue"), (2, "cogs")):
        fallback = out[f"hist_monthday_{m}_mean" + ("_2y" if horizon else "")]
        out[f"lag_1y_{m}"] = earlier[i] if earlier else fallback
    return out


def check(spark, rows, dates, got, horizon):
    expected = {d: brute_row(d, rows, horizon) for d in dates}
    names = list(next(iter(expected.values())))
    medians = {}
    for n in names:
        present = [e[n] for e in expected.values() if e[n] is not None]
        medians[n] = st.median(present) if present else None
    assert set(got) == set(expected)
    for d, e in expected.items():
        for n in names:
            want = medians[n] if e[n] is None else e[n]
            assert got[d][n] == pytest.approx(want), (d, n)


def test_build_matches_definitions_row_by_row(spark):
    rows = make_sales()
    ahead = days(D(2000, 1, 1), D(2000, 12, 31))
    fs = build_features(
        spark.createDataFrame(rows, SALES),
        spark.createDataFrame([(d,) for d in ahead], "date date"),
    )
    got = {r["date"]: r.asDict() for r in fs.train.collect()}
    check(spark, rows, [r[0] for r in rows], got, horizon=False)
    got = {r["date"]: r.asDict() for r in fs.horizon.collect()}
    check(spark, rows, ahead, got, horizon=True)
    first = min(r[0] for r in rows)
    row = got[D(2000, 12, 31)]
    assert row["days_since_start"] == (D(2000, 12, 31) - first).days
    assert row["days_since_start_sq"] == row["days_since_start"] ** 2
    assert row["year_sq"] == 144 and row["dayofyear"] == 366
    assert fs.train.columns == ["date", *fs.columns] == fs.horizon.columns


def test_leap_day_and_slip(spark):
    """Feb 29 has no recent mean; Dec 31 of a leap year looks back to Jan 1."""
    rows = [(d, 100.0, 50.0) for d in days(D(1995, 1, 1), D(1999, 12, 31))]
    sales = spark.createDataFrame(rows, SALES)
    ahead = spark.createDataFrame([(D(2000, 2, 28),), (D(2000, 2, 29),), (D(2000, 12, 31),)], "date date")
    lagged = {r["date"]: r["lag_1y_revenue"] for r in lags.attach_lag(ahead, sales).collect()}
    assert lagged == {D(2000, 2, 28): 100.0, D(2000, 2, 29): 100.0, D(2000, 12, 31): None}
    both = {(r["month"], r["day"]): r for r in seasonal.monthday_means_both(sales).collect()}
    assert both[2, 29]["hist_monthday_revenue_mean"] == 100.0
    assert both[2, 29]["hist_monthday_revenue_mean_2y"] is None
    recent = seasonal.monthday_means_recent(sales)
    assert recent.filter("month = 2 and day = 29").isEmpty()


def test_horizon_fallback_replaces_both_lags(spark):
    df = spark.createDataFrame(
        [(None, 7.0, 1.0, 2.0), (5.0, None, 1.0, 2.0)],
        "lag_1y_revenue double, lag_1y_cogs double, "
        "hist_monthday_revenue_mean_2y double, hist_monthday_cogs_mean_2y double",
    )
    got = lags.fill_horizon_lag(df).select("lag_1y_revenue", "lag_1y_cogs").collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0), (5.0, None)]


def test_growth_spans_a_missing_year(spark):
    rows = [(D(2012, 1, 1), 100.0, 10.0), (D(2013, 1, 1), 150.0, 0.0), (D(2015, 1, 1), 300.0, 5.0)]
    got = growth.yoy_growth(spark.createDataFrame(rows, SALES)).orderBy("year").collect()
    assert [r["hist_yoy_revenue_growth"] for r in got] == [None, 0.5, 1.0]
    assert [r["hist_yoy_rev_growth_3y"] for r in got] == [None, 0.5, 0.75]
    assert [r["hist_yoy_cogs_growth"] for r in got] == [None, -1.0, math.inf]
    assert got[2]["hist_yoy_cogs_growth_3y"] == -1.0  # infinities stay out of the mean


def test_median_fill_rules(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None), (2, None, None), (3, math.inf, None), (4, 4.0, None)],
        "i int, x double, empty double",
    )
    own = {r["i"]: (r["x"], r["empty"]) for r in impute.fill_own_median(df, ["x", "empty"]).collect()}
    assert own[2] == (4.0, None) and own[3] == (math.inf, None)
    full = impute.fill_train_median(df, df, ["x", "empty"], clear_infinite=True)
    got = {r["i"]: (r["x"], r["empty"]) for r in full.collect()}
    assert got == {1: (1.0, 0.0), 2: (4.0, 0.0), 3: (4.0, 0.0), 4: (4.0, 0.0)}


def test_many_series_equal_one_at_a_time(spark):
    """Series keys change the plan, not the numbers."""
    ahead = days(D(1999, 1, 1), D(1999, 3, 31))
    names = ["a", "b", "c"]
    rows = {n: make_sales(seed=i, first=D(1997, 1, 1 + i), last=D(1998, 12, 31)) for i, n in enumerate(names)}
    keyed = spark.createDataFrame([(n, *r) for n in names for r in rows[n]], "s string, " + SALES)
    dates = spark.createDataFrame([(n, d) for n in names for d in ahead], "s string, date date")
    orders = [(n, f"{n}{i}", f"c{i % 4}", r[0]) for n in names for i, r in enumerate(rows[n])]
    order_schema = "s string, order_id string, customer_id string, order_date date"
    fs = build_features(
        keyed, dates, Facts(orders=spark.createDataFrame(orders, order_schema)), keys=["s"]
    )
    for n in ("a", "c"):
        alone = build_features(
            spark.createDataFrame(rows[n], SALES),
            spark.createDataFrame([(d,) for d in ahead], "date date"),
            Facts(orders=spark.createDataFrame([o for o in orders if o[0] == n], order_schema)),
        )
        for got, want in ((fs.train, alone.train), (fs.horizon, alone.horizon)):
            mine = {r["date"]: r for r in got.filter(F.col("s") == n).drop("s").collect()}
            assert mine == {r["date"]: r for r in want.collect()}


def test_row_order_and_partitioning_do_not_matter(spark):
    rows = make_sales(seed=5, first=D(1998, 1, 1), last=D(1999, 12, 31))
    mixed = rows[:]
    random.Random(0).shuffle(mixed)
    ahead = spark.createDataFrame([(D(2000, 1, 1),), (D(2000, 6, 1),)], "date date")
    a = build_features(spark.createDataFrame(rows, SALES).coalesce(1), ahead).train.collect()
    b = build_features(spark.createDataFrame(mixed, SALES).repartition(7), ahead).train.collect()
    assert sorted(a) == sorted(b)
