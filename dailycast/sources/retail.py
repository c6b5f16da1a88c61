"""Star-schema tables seen through the input schemas of the pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.functions.numeric import part_columns, part_sums, parts_total
from dailycast.sources.tables import Facts


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def orders(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )


def order_items(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_quantity").alias("quantity"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
    )


def returns(spark: SparkSession, root: str) -> DataFrame:
    return (
        table(spark, root, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select(F.col("l_orderkey").alias("order_id"))
    )


def web_traffic(spark: SparkSession, root: str) -> DataFrame:
    """Lines shipped per day stand in for sessions."""
    return (
        table(spark, root, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.count(F.lit(1)).alias("sessions"))
    )


def facts(spark: SparkSession, root: str) -> Facts:
    return Facts(
        orders=orders(spark, root),
        order_items=order_items(spark, root),
        returns=returns(spark, root),
        web_traffic=web_traffic(spark, root),
    )


def order_totals(spark: SparkSession, root: str) -> DataFrame:
    """Revenue and cost of every order, in exact parts.

    Lines are combined per order before the shuffle, so an order holding a
    large share of all lines reaches the exchange as one row per map task, and
    the join to the order headers reuses the same partitioning. The part join
    carries no hint: parts grow with the data, so size statistics choose
    between a broadcast and a skew-aware sort-merge join.
    """
    lines = table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    prices = table(spark, root, "part").select("p_partkey", "p_retailprice")
    return (
        lines.join(prices, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey",
            *part_columns("l_extendedprice * (1D - l_discount)", "rev"),
            *part_columns("l_quantity * p_retailprice", "cost"),
        )
        .groupBy("l_orderkey")
        .agg(*part_sums("rev"), *part_sums("cost"))
    )


def daily_sales(
    spark: SparkSession, root: str, keys: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Revenue and cost per order date, and per series when ``keys`` is given.

    ``keys`` maps a series column to ``("orders" | "customer", source column)``.
    """
    keys = keys or {}
    header = table(spark, root, "orders")
    wanted = [F.col(col).alias(name) for name, (src, col) in keys.items() if src == "orders"]
    dims = {name: col for name, (src, col) in keys.items() if src == "customer"}
    header = header.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"), *wanted
    )
    if dims:
        customer = table(spark, root, "customer").select(
            "c_custkey", *[F.col(col).alias(name) for name, col in dims.items()]
        )
        header = header.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return (
        order_totals(spark, root)
        .join(header, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(*keys, "date")
        .agg(
            F.expr(parts_total("rev")).alias("revenue"),
            F.expr(parts_total("cost")).alias("cogs"),
        )
    )
