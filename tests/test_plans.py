"""Physical plans: what is read, what is shuffled, and how uneven keys are split."""

import datetime as dt
import re
from contextlib import contextmanager

import duckdb
import pytest
from pyspark.sql import functions as F

from dailycast.catalog import QUERIES
from dailycast.operators import attach
from dailycast.plans.features import build_features
from dailycast.sources import retail

ROOT = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **conf):
    names = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1"}


def test_roll_up_reads_only_its_columns(spark):
    plan = executed(retail.daily_sales(spark, ROOT))
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    names = [{c.split("#")[0] for c in r.split(",")} for r in read]
    assert {"l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"} in names
    assert {"o_orderkey", "o_orderdate"} in names and {"p_partkey", "p_retailprice"} in names


def test_lines_are_combined_per_order_before_the_shuffle(spark):
    with settings(spark, **NO_BROADCAST):
        plan = executed(retail.daily_sales(spark, ROOT))
    assert "partial_sum(rev" in plan.split("Exchange hashpartitioning(l_orderkey")[1]
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1


def test_returns_filter_reaches_the_scan(spark):
    plan = executed(retail.returns(spark, ROOT))
    assert "EqualTo(l_returnflag,R)" in plan


@pytest.mark.parametrize(
    "name", ["jn_scalar_broadcast", "jn_fold_interval", "jn_seasonal_attach", "feat_train", "ts_fold_assign"]
)
def test_no_cross_or_nested_loop_join(spark, name):
    plan = executed(QUERIES[name](spark, ROOT))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_series_are_shuffled_by_series_only(spark):
    rows = [
        (s, dt.date(2020, 1, 1) + dt.timedelta(i), 1.0 + i, 1.0) for s in "abc" for i in range(800)
    ]
    sales = spark.createDataFrame(rows, "s string, date date, revenue double, cogs double")
    ahead = spark.createDataFrame([("a", dt.date(2023, 1, 1))], "s string, date date")
    with settings(spark, **NO_BROADCAST):
        fs = build_features(sales, ahead, keys=["s"], staged=False)
        plan = executed(fs.train)
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#\d+, \d+\)", plan)) == {"s"}
    assert len(re.findall(r"Exchange", plan)) == len(
        re.findall(r"Exchange hashpartitioning\(s#\d+, \d+\)", plan)
    ) + plan.count("ReusedExchange")


@pytest.fixture(scope="module")
def uneven(spark, tmp_path_factory):
    """Tables in which one part holds a third of all lines."""
    root = str(tmp_path_factory.mktemp("uneven"))
    spark.range(240_000).selectExpr(
        "id % 60000 as l_orderkey",
        "if(id % 3 = 0, 1, 2 + id % 5000) as l_partkey",
        "cast(1 + id % 7 as double) as l_quantity",
        "cast(100 + id % 900 as double) as l_extendedprice",
        "(id % 10) / 100D as l_discount",
    ).write.parquet(f"{root}/lineitem.parquet")
    spark.range(60_000).selectExpr(
        "id as o_orderkey",
        "if(id % 3 = 0, 1, id) as o_custkey",
        "timestamp_ntz'2020-01-01' + make_dt_interval(cast(id % 900 as int)) as o_orderdate",
    ).write.parquet(f"{root}/orders.parquet")
    spark.range(1, 6000).selectExpr(
        "id as p_partkey", "cast(10 + id % 90 as double) as p_retailprice"
    ).write.parquet(f"{root}/part.parquet")
    return root


def test_hot_part_is_split_and_totals_stay_whole(spark, uneven):
    small = {
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "100KB",
        "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "100KB",
        "spark__sql__adaptive__coalescePartitions__enabled": "false",
        "spark__sql__shuffle__partitions": "8",
        "spark__sql__files__maxPartitionBytes": "200KB",
    }
    with settings(spark, **NO_BROADCAST, **small):
        df = retail.daily_sales(spark, uneven)
        plan = executed(df)
        got = sorted((str(r["date"]), r["revenue"], r["cogs"]) for r in df.collect())
    assert "skew=true" in plan
    t = lambda n: f"'{uneven}/{n}.parquet/*.parquet'"
    want = duckdb.sql(
        f"""select cast(o_orderdate as date)::varchar,
                   sum(l_extendedprice * (1 - l_discount)), sum(l_quantity * p_retailprice)
            from {t("lineitem")} join {t("orders")} on l_orderkey = o_orderkey
                 join {t("part")} on l_partkey = p_partkey group by 1"""
    ).fetchall()
    assert [r[0] for r in got] == [r[0] for r in sorted(want)]
    assert [x for r in got for x in r[1:]] == pytest.approx([x for r in sorted(want) for x in r[1:]], rel=1e-13)


def test_heavy_join_splits_the_hot_key_alone(spark, uneven):
    orders = retail.orders(spark, uneven)
    first = orders.groupBy("customer_id").agg(F.min("order_date").alias("first"), F.count("*").alias("n"))
    plain = orders.join(first, "customer_id", "left").select("order_id", "first")
    joined = attach.heavy_left_join(orders, first, "customer_id", "n", spread="order_id", share=8, least=10)
    assert {*joined.columns} == {*orders.columns, "first"} and joined.count() == orders.count()
    assert joined.select("order_id", "first").exceptAll(plain).isEmpty()
    with settings(spark, **NO_BROADCAST):
        plan = executed(joined)
        assert "_salt" in plan.split("SortMergeJoin")[1].split("]")[0]


def test_heavy_join_moves_the_dimension_about_once(spark):
    left = spark.range(40_000).selectExpr("if(id < 20000, 7, id) as k", "id as row").unionByName(
        spark.range(50).selectExpr("cast(null as bigint) as k", "id as row")
    )
    right = left.filter("k is not null").groupBy("k").agg(F.max("row").alias("last"), F.count("*").alias("n"))
    joined = attach.heavy_left_join(left, right, "k", "n", spread="row", share=100, least=100)
    assert joined.filter("k is null and last is not null").isEmpty() and joined.count() == 40_050
    assert joined.filter("k = 7").select("last").distinct().collect() == [(19_999,)]
    copies = joined._jdf.queryExecution().analyzed().toString().count("Generate")
    assert copies == 1
    heavy = right.filter("n >= 400")
    assert [tuple(r) for r in heavy.collect()] == [(7, 19_999, 20_000)]  # 50 copies of this row, one of each other
