"""Exact quantiles against NumPy and Spark's own percentile."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dailycast.operators import impute, quantiles


def spark_percentiles(df, c, shares):
    return df.agg(F.expr(f"percentile({c}, array({', '.join(map(str, shares))}))").alias("p")).first()["p"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False), st.sampled_from([0.0, 1.0, -2.5])), min_size=1, max_size=40))
def test_any_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = quantiles.exact_medians(df, ["x"]).first()
    known = sorted(v for v in values if v is not None)
    n = len(known)
    if n:
        a, b = known[(n - 1) // 2], known[n // 2]
        assert row["x"] == (a if a == b else 0.5 * a + 0.5 * b)
    else:
        assert row["x"] is None


def test_distinct_values_by_the_million_and_a_hot_one(spark):
    """The spread goes from 1e-300 to 1e300; a third of the rows is one value."""
    df = spark.range(1_000_000, numPartitions=8).select(
        (F.pow(F.lit(10.0), F.lit(600.0) * F.rand(1) - 300) * F.when(F.rand(2) < 0.5, -1).otherwise(1)).alias("wide"),
        F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.rand(3)).alias("hot"),
    ).persist()
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, ["wide", "hot"], shares).orderBy("share").collect()
    for c in ("wide", "hot"):
        assert [r[c] for r in got] == spark_percentiles(df, c, shares)
    df.unpersist()


def test_no_pass_moves_more_than_its_ranges(spark, monkeypatch):
    seen = []
    real = quantiles._histogram
    monkeypatch.setattr(quantiles, "_histogram", lambda d, p: (seen.append(real(d, p)), seen[-1])[1])
    df = spark.range(300_000).select(F.rand(5).alias("x"))
    values = np.array([r["x"] for r in df.collect()])
    assert quantiles.exact_medians(df, ["x"]).first()["x"] == np.median(values)
    assert len(seen) <= 6 and max(len(v) for h in seen for v in h.values()) <= quantiles.RANGES + 1


def test_infinities_nan_and_odd_names(spark):
    inf = float("inf")
    rows = [(-inf, 1.0), (2.0, None), (3.0, None), (inf, float("nan")), (None, 0.0)]
    df = spark.createDataFrame(rows, "`a.b` double, y double").withColumn("none", F.lit(None).cast("double"))
    row = quantiles.exact_medians(df, ["a.b", "y", "none"]).first()
    assert row["a.b"] == 2.5 and row["y"] == 1.0 and row["none"] is None
    assert quantiles.exact_quantiles(df, ["y"], [1.0]).first()["y"] != quantiles.exact_quantiles(df, ["y"], [1.0]).first()["y"]
    assert quantiles.exact_medians(df.limit(0), ["y"]).first()["y"] is None
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(df, ["y"], [1.5])


def test_medians_fill_a_table_of_any_grain(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0), (4, 6.0)], "id int, x double")
    filled = impute.fill_from(df, quantiles.exact_medians(df, ["x"]), ["x"])
    assert [r["x"] for r in filled.orderBy("id").collect()] == [1.0, 5.0, 5.0, 6.0]
