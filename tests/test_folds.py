"""Fold sizes and order, positions, boundaries and interval matching."""

import datetime as dt

import pytest

from dailycast.operators import folds

START = dt.date(1999, 12, 20)


def dates(spark, n, step=1):
    rows = [(START + dt.timedelta(i * step),) for i in range(n)]
    return spark.createDataFrame(rows, "date date").repartition(3)


@pytest.mark.parametrize("n", [6, 7, 11, 12, 2399])
def test_sizes_and_order(spark, n):
    rows = sorted(folds.assign_folds(dates(spark, n)).collect())
    assert [r["position"] for r in rows] == list(range(n))
    size = n // 6
    expected = [0] * (n - 5 * size) + [k for k in range(1, 6) for _ in range(size)]
    assert [r["fold"] for r in rows] == expected


def test_bounds(spark):
    assigned = folds.assign_folds(dates(spark, 25, step=7))
    days = [r["date"] for r in sorted(assigned.collect())]
    got = sorted(folds.fold_bounds(assigned).collect())
    for k, r in enumerate(got, 1):
        first = 25 - 5 * 4 + (k - 1) * 4
        assert tuple(r) == (k, days[0], days[first - 1], days[first], days[first + 3])
    assert got[-1]["val_end"] == days[-1]


def test_interval_match_keeps_only_validated_rows(spark):
    rows = dates(spark, 25)
    assigned = folds.assign_folds(rows)
    got = {r["date"]: r["fold"] for r in folds.in_fold_range(rows, folds.fold_bounds(assigned)).collect()}
    assert got == {r["date"]: r["fold"] for r in assigned.collect() if r["fold"] > 0}


def test_positions_per_series(spark):
    rows = [("a", START), ("a", START + dt.timedelta(400)), ("b", START), ("a", START)]
    df = spark.createDataFrame(rows, "s string, date date")
    got = sorted(tuple(r) for r in folds.date_positions(df, ["s"]).collect())
    assert [(s, p) for s, _, p in got] == [("a", 0), ("a", 1), ("b", 0)]
