"""Readers, header rules, leak guard, target check, sinks and staging."""

import os
import subprocess
import sys
import datetime as dt

import pytest

from dailycast.sources import sinks, tables
from dailycast.sources.staging import run_together, stage, stage_path


def test_headers(spark):
    one = [(1.0, 2.0)]
    names = lambda *c: tables.canonical_targets(spark.createDataFrame(one, list(c))).columns
    assert names("revenue", "cogs") == ["Revenue", "COGS"]
    assert names("net_revenue", "CoGs") == ["Revenue", "COGS"]
    assert names("Revenue", "net_revenue") == ["Revenue", "net_revenue"]
    with pytest.raises(ValueError):
        names("REVENUE", "net_revenue")


def test_leak_guard_is_exact(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], ["x", "Revenue", "COGS"])
    assert tables.drop_leaks(df).columns == ["x"]


def test_target_must_be_complete(spark):
    x = spark.createDataFrame([(1,), (2,)], "date int")
    y = spark.createDataFrame([(1, 1.0, 1.0)], "date int, revenue double, cogs double")
    with pytest.raises(ValueError):
        tables.attach_target(x, y)
    assert tables.attach_target(x.filter("date = 1"), y).collect() == [(1, 1.0, 1.0)]


def test_alignment(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, extra string")
    out = tables.align_columns(df, ["b", "new", "a"])
    assert out.columns == ["b", "new", "a"] and out.collect() == [(2.0, None, 1)]


def test_csv_by_header_name(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("COGS,note,Date,Revenue\n1.5,x,2020-01-02,NaN\n2.5,y,2020-01-03,4\n")
    got = sorted(tables.read_sales(spark, str(p)).collect())
    assert got == [(dt.date(2020, 1, 2), None, 1.5), (dt.date(2020, 1, 3), 4.0, 2.5)]
    assert tables.read_horizon(spark, str(p)).columns == ["date"]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(p), tables.ORDERS)


def test_optional_files(spark, tmp_path):
    (tmp_path / "web_traffic.csv").write_text("date,sessions\n2020-01-01,5\n")
    facts = tables.read_facts(spark, str(tmp_path))
    assert facts.orders is None and facts.returns is None
    assert facts.web_traffic.collect() == [(dt.date(2020, 1, 1), 5)]


def test_forecast_sink_per_variant(spark, tmp_path):
    df = spark.createDataFrame(
        [("2020-01-01", 1.0, 0.5, "stack"), ("2020-01-01", 2.0, 0.5, "stack_residual")],
        ["Date", "Revenue", "COGS", "variant"],
    )
    sinks.write_forecast(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "variant=stack"))
    assert back.columns == ["Date", "Revenue", "COGS"] and back.count() == 1


def test_stage_reads_back_the_same_rows(spark):
    df = spark.range(100).selectExpr("id", "id * 2 as twice")
    a, b = run_together(spark, [lambda: stage(df, "t1"), lambda: stage(df, "t2", 1)])
    assert a.dtypes == df.dtypes and sorted(a.collect()) == sorted(b.collect()) == df.collect()
    assert stage_path(spark, "x") != stage_path(spark, "x")


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NO_FOLDER = """
from pyspark.sql import SparkSession
from dailycast.sources import staging
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
try:
    staging.stage(spark.range(3), "x")
    print("NOT REFUSED")
except ValueError as e:
    print("REFUSED", e)
spark.sparkContext.setCheckpointDir(FOLDER)
print("ROWS", staging.stage(spark.range(3), "x").count())
staging.clear_staging(spark)
"""


def test_staging_without_the_setting(tmp_path):
    """A session without a folder is refused; one given later is used, and cleared."""
    (tmp_path / "conf").mkdir()
    done = subprocess.run(
        [sys.executable, "-c", f"FOLDER = {str(tmp_path / 'shared')!r}\n{NO_FOLDER}"],
        env=os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": ROOT},
        cwd=tmp_path,
        capture_output=True,
        text=True,
        timeout=200,
    )
    assert "REFUSED set spark.checkpoint.dir" in done.stdout and "ROWS 3" in done.stdout, done.stderr
    assert not list((tmp_path / "shared").rglob("*.parquet"))
