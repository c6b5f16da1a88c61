"""Hand-computed edge cases of the column expressions and scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dailycast.functions import metrics, numeric
from dailycast.functions.calendar import cyclic_parts, shift_days, trend_parts, with_calendar

INF, NAN = math.inf, math.nan


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_calendar_parts(spark):
    rows = [("2000-02-29",), ("2000-12-31",), ("1999-01-04",)]
    df = with_calendar(spark.createDataFrame(rows, "d string").select(F.to_date("d").alias("date")))
    got = [tuple(r)[1:] for r in df.collect()]
    assert got == [
        (2, 29, 1, 60, 2000, 1),
        (12, 31, 6, 366, 2000, 4),
        (1, 4, 0, 4, 1999, 1),
    ]


def test_shift_is_days_not_a_year(spark):
    rows = [("2000-01-01",), ("1999-02-28",), ("2000-02-29",)]
    df = spark.createDataFrame(rows, "d string").select(F.to_date("d").alias("date"))
    got = [str(r[0]) for r in df.select(shift_days("date")).collect()]
    assert got == ["2000-12-31", "2000-02-28", "2001-02-28"]


def test_trend_does_not_overflow_int(spark):
    df = spark.createDataFrame([(60000, 2013)], "days_since_start int, year int")
    row = df.select(*[c.alias(n) for n, c in trend_parts().items()]).first()
    assert tuple(row) == (3_600_000_000, 1)


def test_cyclic_encoding(spark):
    df = spark.createDataFrame([(100,)], "dayofyear int")
    row = df.select(*[c.alias(n) for n, c in cyclic_parts().items()]).first()
    angle = 2 * math.pi * 100 / 365.25
    assert row["day_sin"] == pytest.approx(math.sin(angle))
    assert row["day_cos"] == pytest.approx(math.cos(angle))


def test_ratio_edges(spark):
    rows = [(6.0, 3.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 2.0), (1.0, None)]
    got = values(spark, rows, "n double, d double", numeric.ratio("n", "d"))
    assert got == [2.0, INF, -INF, None, None, None]


def test_money_sum_is_exact_and_zero_when_empty(spark):
    rows = [("a", 0.1)] * 10 + [("b", None)]
    df = spark.createDataFrame(rows, "k string, x double").groupBy("k")
    got = {r[0]: r[1:] for r in df.agg(numeric.money_sum("x"), numeric.money_mean("x")).collect()}
    assert got == {"a": (1.0, 0.1), "b": (0.0, None)}


def test_small_large_and_infinite_amounts(spark):
    rows = [("a", 0.004)] * 1000 + [("b", 9e9)] * 300 + [("c", NAN), ("c", INF), ("c", 10.0)]
    df = spark.createDataFrame(rows, "k string, x double").groupBy("k")
    got = {r[0]: r[1:] for r in df.agg(numeric.money_sum("x"), numeric.money_mean("x")).collect()}
    assert got == {"a": (4.0, 0.004), "b": (2.7e12, 9e9), "c": (10.0, 10.0)}


def test_amounts_of_any_size_are_added_exactly(spark):
    rows = [("a", 1e12), ("a", 3e12)] + [("b", 3e-9)] * 1000 + [("c", 1e30), ("c", 1.0), ("c", -1e30), ("d", 1e200), ("d", 2e200)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7).groupBy("k")
    got = {r[0]: r[1:] for r in df.agg(numeric.money_sum("x"), numeric.money_mean("x")).collect()}
    assert got["a"] == (4e12, 2e12) and got["b"] == (math.fsum([3e-9] * 1000), got["b"][0] / 1000)
    assert got["c"][0] == 1.0 and got["d"] == (3e200, 1.5e200)


def test_amounts_add_up_alike_in_any_grouping(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), rng.randrange(90), rng.uniform(-1, 1) * 10 ** rng.uniform(-14, 28)) for _ in range(3000)]
    rows += [(4, i, rng.choice([-1, 1]) * rng.uniform(0, 1e5)) for i in range(900)]
    rows += [(5 + i % 200, i, round(rng.uniform(0, 1e6), 2)) for i in range(4000)]  # sums just past a digit's reach
    want = {k: math.fsum(x for j, _, x in rows if j == k) for k in range(205)}
    df = spark.createDataFrame(rows, "k int, part int, x double")
    once = df.groupBy("k").agg(numeric.money_sum("x").alias("x"))
    parts = df.repartition(5, "part").select("k", "part", *numeric.part_columns("x", "p"))
    parts = parts.groupBy("k", "part").agg(*numeric.part_sums("p"))
    twice = parts.groupBy("k").agg(F.expr(numeric.parts_total("p")).alias("x"))
    for got in (once, twice):
        assert {r["k"]: r["x"] for r in got.collect()} == want
    alone = parts.select("k", "part", F.expr(numeric.parts_value("p")).alias("x")).filter("k = 4").collect()
    assert {(r["part"], r["x"]) for r in alone} == {(p, x) for k, p, x in rows if k == 4}


def test_sums_of_many_large_parts_do_not_overflow(spark):
    names = numeric.part_names("p")
    row = [*(f"{2**61}L as {n}" for n in names[:-1]), f"0D as {names[-1]}"]
    got = spark.range(40).selectExpr(*row).agg(F.expr(numeric.parts_total("p"))).first()[0]
    assert got == float(sum(40 * 2**61 * 2 ** (26 * k) for k in range(8))) / 2.0**104


def test_cents_round_half_to_even_in_binary(spark):
    rows = [(x,) for x in (140485.675, 0.125, 2.675, -0.005, 1e300, 3.0)]
    got = values(spark, [*rows, (None,)], "x double", numeric.round_cents("x"))
    assert got == [*np.round([x for x, in rows], 2).tolist(), None]


def test_unlog_clips_and_floors(spark):
    got = values(spark, [(0.0,), (-5.0,), (25.0,), (None,)], "x double", numeric.unlog("x"))
    assert got[:2] == [0.0, 0.0]
    assert got[2] == pytest.approx(math.expm1(20.0)) and got[3] is None
    low = values(spark, [(-25.0,)], "x double", numeric.clipped_expm1("x"))
    assert low[0] == pytest.approx(math.expm1(-20.0))


def test_margin_cap(spark):
    rows = [(50.0, 100.0), (100.0, 100.0), (10.0, -5.0), (-3.0, 10.0), (None, 1.0), (1.0, None)]
    got = values(spark, rows, "c double, r double", numeric.cap_to_margin("c", "r"))
    assert got == [50.0, 99.5, 0.0, 0.0, None, None]


def test_row_mean_skips_nulls(spark):
    rows = [(1.0, 3.0), (None, 4.0), (None, None)]
    assert values(spark, rows, "a double, b double", numeric.row_mean("a", "b")) == [2.0, 4.0, None]


def scored(spark, rows):
    df = spark.createDataFrame(rows, "actual double, pred double")
    return tuple(metrics.score(df).first())


def test_scores_on_plain_rows(spark):
    mape, r2 = scored(spark, [(10.0, 11.0), (20.0, 18.0), (40.0, 40.0)])
    assert mape == pytest.approx((0.1 + 0.1 + 0) / 3)
    mean = 70 / 3
    tot = sum((a - mean) ** 2 for a in (10, 20, 40))
    assert r2 == pytest.approx(1 - 5 / tot)


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1.0, NAN), (None, 1.0), (INF, 2.0)], (INF, 0.0)),  # no finite pair
        ([(5.0, 5.0), (5.0, 5.0)], (0.0, 1.0)),  # constant and exact
        ([(5.0, 6.0), (5.0, 5.0)], (0.1, 0.0)),  # constant and wrong
    ],
)
def test_score_edges(spark, rows, expected):
    assert scored(spark, rows) == pytest.approx(expected)


def test_zero_actual_is_scored_against_epsilon(spark):
    assert scored(spark, [(0.0, 1.0)])[0] == pytest.approx(1e9)


def test_r2_survives_a_large_offset(spark):
    rows = [(1e9 + i, 1e9 + i + 0.5) for i in range(100)]
    var = sum((i - 49.5) ** 2 for i in range(100))
    assert scored(spark, rows)[1] == pytest.approx(1 - 25.0 / var, abs=1e-9)


def test_finite_pairs(spark):
    rows = [(1.0, 1.0), (NAN, 1.0), (1.0, INF), (None, 1.0)]
    df = spark.createDataFrame(rows, "actual double, pred double")
    assert metrics.finite_pairs(df).count() == 1
