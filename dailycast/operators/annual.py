"""Annual structural metrics from the transaction and traffic facts.

Everything is combined before it is shuffled: a customer, order or year that
holds a large share of the rows reaches an exchange as one row per map task.
Orders are grouped by ``order_id`` alone, with the set of their years; lines and
returns are joined to that in the partitioning their own aggregation produced, and
years are unfolded after the joins, so orders are exchanged once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dailycast.functions.numeric import part_columns, part_sums, parts_total, ratio
from dailycast.operators.attach import attach_row
from dailycast.operators.growth import row_growth
from dailycast.sources.tables import Facts

TAIL_YEARS = 3

ORDER_METRICS = [
    "annual_unique_customers",
    "annual_total_orders",
    "annual_new_customer_rate",
    "annual_aov",
    "annual_discount_intensity",
    "annual_return_rate",
]
TRAFFIC_METRICS = ["annual_sessions", "annual_sessions_growth"]


def with_order_year(orders: DataFrame) -> DataFrame:
    return orders.withColumn("year", F.year("order_date"))


def customer_years(orders: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Orders per customer and year, next to the customer's first year.

    The window sees at most one row per year for each customer, however many
    orders the customer placed. NULL customers have no first year.
    """
    per_year = (
        with_order_year(orders)
        .filter(F.col("year").isNotNull())
        .groupBy(*keys, "customer_id", "year")
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    first = F.min("year").over(Window.partitionBy(*keys, "customer_id"))
    return per_year.withColumn("first_year", F.when(F.col("customer_id").isNotNull(), first))


def order_counts(orders: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct customers, orders and the share of orders by new customers.

    One aggregation over the customer-year table gives all three, because each of
    its rows is one distinct customer of that year.
    """
    return (
        customer_years(orders, keys)
        .groupBy(*keys, "year")
        .agg(
            F.count("customer_id").alias("annual_unique_customers"),
            F.sum("orders").alias("annual_total_orders"),
            ratio("sum(if(year = first_year, orders, 0))", "sum(orders)").alias(
                "annual_new_customer_rate"
            ),
        )
    )


def order_sets(orders: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per order with the distinct (keys, year) it belongs to.

    An order repeats at most once per series and year. Orders without an id or a date
    belong to no year.
    """
    return (
        with_order_year(orders)
        .filter(F.col("year").isNotNull() & F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.collect_set(F.struct(*keys, "year")).alias("_when"))
    )


def _unfold(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    when = F.col("_when")
    rest = [c for c in df.columns if c != "_when"]
    return df.select(*rest, F.explode(when).alias("_when")).select(
        *rest, *[F.col(f"_when.{c}").alias(c) for c in (*keys, "year")]
    )


def order_years(orders: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (order, year) pairs."""
    return _unfold(order_sets(orders, keys), keys).select(*keys, "order_id", "year")


def item_totals(items: DataFrame) -> DataFrame:
    """Value and discount of every order, in exact parts."""
    parts = [*part_columns("quantity * unit_price", "value"), *part_columns("discount_amount", "discount")]
    sums = [*part_sums("value"), *part_sums("discount")]
    return items.select("order_id", *parts).groupBy("order_id").agg(F.lit(1).alias("_lines"), *sums)


def order_facts(
    orders: DataFrame,
    items: DataFrame | None = None,
    returns: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Line value, discount and returned orders by order year, from one exchange of orders.

    Years none of whose orders has a line, or a return, have NULL there; lines and returns
    of unknown orders fall away.
    """
    df = order_sets(orders, keys)
    sums = []
    if items is not None:
        df = df.join(item_totals(items), "order_id", "left")
        sums += [
            F.expr(f"if(count(_lines) > 0, {parts_total(part)}, null)").alias(name)
            for part, name in (("value", "total_value"), ("discount", "total_discount"))
        ]
    if returns is not None:
        back = returns.select("order_id").distinct().withColumn("_returned", F.lit(1))
        df = df.join(back, "order_id", "left")
        sums.append(F.expr("nullif(count(_returned), 0)").alias("annual_returned_orders"))
    return _unfold(df, keys).groupBy(*keys, "year").agg(*sums)


def order_values(orders: DataFrame, items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Line value and discount by order year, of the years that have lines."""
    return order_facts(orders, items, keys=keys).filter(F.col("total_value").isNotNull())


def returned_orders(
    orders: DataFrame, returns: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Distinct returned orders by order year, of the years that have some."""
    facts = order_facts(orders, returns=returns, keys=keys)
    return facts.filter(F.col("annual_returned_orders").isNotNull())


def value_ratios(values: DataFrame, counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average order value and discount intensity."""
    on = [*keys, "year"]
    return values.join(counts.select(*on, "annual_total_orders"), on, "left").select(
        *on,
        ratio("total_value", "annual_total_orders").alias("annual_aov"),
        ratio("total_discount", "total_value").alias("annual_discount_intensity"),
    )


def return_ratios(counts: DataFrame, returned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    on = [*keys, "year"]
    return counts.select(*on, "annual_total_orders").join(returned, on, "left").select(
        *on, ratio("annual_returned_orders", "annual_total_orders").alias("annual_return_rate")
    )


def sessions(traffic: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sessions per year and their growth over the previous year present."""
    yearly = (
        traffic.withColumn("year", F.year("date"))
        .filter(F.col("year").isNotNull())
        .groupBy(*keys, "year")
        .agg(F.coalesce(F.sum("sessions"), F.lit(0)).alias("annual_sessions"))
    )
    return yearly.withColumn("annual_sessions_growth", row_growth("annual_sessions", keys))


def annual_metrics(facts: Facts, keys: Sequence[str] = ()) -> DataFrame | None:
    """One row per year; ``None`` when there are neither orders nor traffic.

    Items and returns count only together with orders. Missing optional tables
    leave their metrics NULL; missing traffic leaves its columns out.
    """
    on = [*keys, "year"]
    out = None
    if facts.orders is not None:
        counts = order_counts(facts.orders, keys)
        out = counts
        if facts.order_items is not None or facts.returns is not None:
            out = out.join(order_facts(facts.orders, facts.order_items, facts.returns, keys), on, "left")
        if facts.order_items is not None:
            out = out.withColumns(
                {
                    "annual_aov": ratio("total_value", "annual_total_orders"),
                    "annual_discount_intensity": ratio("total_discount", "total_value"),
                }
            )
        if facts.returns is not None:
            out = out.withColumn(
                "annual_return_rate", ratio("annual_returned_orders", "annual_total_orders")
            )
        out = out.selectExpr(
            *on,
            *[f"cast({c if c in out.columns else 'null'} as double) as {c}" for c in ORDER_METRICS],
        )
    if facts.web_traffic is not None:
        visits = sessions(facts.web_traffic, keys).selectExpr(
            *on, *[f"cast({c} as double) as {c}" for c in TRAFFIC_METRICS]
        )
        out = visits if out is None else out.join(visits, on, "left")
    return out


def missing_years(years: DataFrame, metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Years that have no metrics of their own."""
    return years.join(metrics, [*keys, "year"], "left_anti")


def tail_means(
    metrics: DataFrame, keys: Sequence[str] = (), years: int = TAIL_YEARS
) -> DataFrame:
    """Mean of each metric over the last ``years`` rows, NULLs skipped.

    Summed in year order, not in the order rows arrive, so that the result
    repeats bit for bit.
    """
    cols = [c for c in metrics.columns if c not in (*keys, "year")]
    latest = Window.partitionBy(*keys).orderBy(F.desc("year"))
    tail = metrics.withColumn("_age", F.row_number().over(latest)).filter(
        F.col("_age") <= years
    )
    means = []
    for c in cols:
        in_order = " + ".join(
            f"coalesce(max({c}) filter (where _age = {k}), 0D)" for k in range(years, 0, -1)
        )
        means.append(f"try_divide({in_order}, count({c})) as {c}")
    packed = F.expr(f"struct({', '.join(means)})").alias("_m")
    return tail.groupBy(*keys).agg(packed).select(*keys, "_m.*")


def extrapolate(
    metrics: DataFrame, horizon_years: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Append the years a horizon needs; all get the same tail means."""
    new = attach_row(
        missing_years(horizon_years, metrics, keys), tail_means(metrics, keys), keys
    )
    return metrics.unionByName(new)


