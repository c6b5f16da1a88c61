"""Aggregations and joins over the transaction facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailycast.catalog.registry import query
from dailycast.catalog.sql import METRICS, SPLIT, TRAIN_FACTS, msum, with_ctes
from dailycast.functions.numeric import parts_value
from dailycast.operators import annual, growth, quantiles
from dailycast.operators.attach import heavy_left_join
from dailycast.sources import retail
from dailycast.sources.staging import stage
from dailycast.sources.tables import Facts


@query("prj_fact_year", with_ctes("select order_id, year from o"))
def prj_fact_year(spark, root):
    return annual.with_order_year(retail.orders(spark, root)).select("order_id", "year")


@query(
    "prj_line_value",
    f"""select l_orderkey as order_id, count(*) as lines,
               {msum("l_quantity * (l_extendedprice / l_quantity)")} as line_value
        from lineitem group by 1""",
)
def prj_line_value(spark, root):
    items = retail.order_items(spark, root)
    lines = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"))
    value = F.expr(parts_value("value")).alias("line_value")
    return lines.join(annual.item_totals(items), "order_id").select("order_id", "lines", value)


@query(
    "prj_is_new",
    with_ctes(
        """select o.customer_id, o.year,
                  cast(o.year = f.first_year as integer) as is_new, count(*) as orders
           from o join first_years f using (customer_id) group by 1, 2, 3"""
    ),
)
def prj_is_new(spark, root):
    return annual.customer_years(retail.orders(spark, root)).select(
        "customer_id", "year", (F.col("year") == F.col("first_year")).cast("int").alias("is_new"),
        "orders",
    )


@query(
    "jn_first_year",
    with_ctes(
        """select o.order_id, o.customer_id, o.year, f.first_year
           from o left join first_years f using (customer_id)"""
    ),
)
def jn_first_year(spark, root):
    orders = annual.with_order_year(retail.orders(spark, root))
    first = (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.min("year").alias("first_year"), F.count(F.lit(1)).alias("orders"))
    )
    return heavy_left_join(orders, first, "customer_id", weight="orders", spread="order_id").select(
        "order_id", "customer_id", "year", "first_year"
    )


@query(
    "jn_order_year_lookup",
    with_ctes(
        """select order_id, year, count(*) as lines
           from items join oy using (order_id) group by 1, 2"""
    ),
)
def jn_order_year_lookup(spark, root):
    per_order = (
        retail.order_items(spark, root).groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"))
    )
    return per_order.join(annual.order_years(retail.orders(spark, root)), "order_id").select(
        "order_id", "year", "lines"
    )


@query("agg_unique_customers", with_ctes("select year, customers as annual_unique_customers from counts"))
def agg_unique_customers(spark, root):
    return annual.order_counts(retail.orders(spark, root)).select("year", "annual_unique_customers")


@query("agg_total_orders", with_ctes("select year, n as annual_total_orders from counts"))
def agg_total_orders(spark, root):
    return (
        annual.with_order_year(retail.orders(spark, root))
        .filter(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("annual_total_orders"))
    )


@query("agg_first_year", with_ctes("select customer_id, first_year from first_years"))
def agg_first_year(spark, root):
    return (
        annual.customer_years(retail.orders(spark, root))
        .filter(F.col("year") == F.col("first_year"))
        .select("customer_id", "first_year")
    )


@query("agg_new_customer_rate", with_ctes("select year, new_rate as annual_new_customer_rate from counts"))
def agg_new_customer_rate(spark, root):
    return annual.order_counts(retail.orders(spark, root)).select("year", "annual_new_customer_rate")


@query(
    "jn_annual_inner",
    with_ctes(
        """select year, customers as annual_unique_customers, n as annual_total_orders,
                  new_rate as annual_new_customer_rate from counts"""
    ),
)
def jn_annual_inner(spark, root):
    return annual.order_counts(retail.orders(spark, root))


@query("agg_order_value", with_ctes("select year, total_value, total_discount from vals"))
def agg_order_value(spark, root):
    return annual.order_values(retail.orders(spark, root), retail.order_items(spark, root))


@query("agg_aov", with_ctes("select year, annual_aov, annual_discount_intensity from ann"))
def agg_aov(spark, root):
    orders = retail.orders(spark, root)
    values = annual.order_values(orders, retail.order_items(spark, root))
    return annual.value_ratios(values, annual.order_counts(orders))


@query("agg_return_rate", with_ctes("select year, annual_return_rate from ann"))
def agg_return_rate(spark, root):
    orders = retail.orders(spark, root)
    back = annual.returned_orders(orders, retail.returns(spark, root))
    return annual.return_ratios(annual.order_counts(orders), back)


@query("agg_sessions", with_ctes("select year, annual_sessions from sess"))
def agg_sessions(spark, root):
    return annual.sessions(retail.web_traffic(spark, root)).select("year", "annual_sessions")


@query("win_sessions_growth", with_ctes("select year, annual_sessions_growth from sessg"))
def win_sessions_growth(spark, root):
    return annual.sessions(retail.web_traffic(spark, root)).select("year", "annual_sessions_growth")


_ANN = ", ".join(METRICS)


@query("annual_metrics", with_ctes(f"select year, {_ANN} from ann"))
def annual_metrics(spark, root):
    return annual.annual_metrics(retail.facts(spark, root))


@query(
    "src_optional_missing",
    with_ctes(
        """select year, annual_unique_customers, annual_total_orders, annual_new_customer_rate,
                  cast(null as double) as annual_aov,
                  cast(null as double) as annual_discount_intensity,
                  cast(null as double) as annual_return_rate
           from ann"""
    ),
)
def src_optional_missing(spark, root):
    return annual.annual_metrics(Facts(orders=retail.orders(spark, root)))


_TAIL_ORDERED = ", ".join(
    "(coalesce(max({0}) filter (age = 3), 0) + coalesce(max({0}) filter (age = 2), 0)"
    " + coalesce(max({0}) filter (age = 1), 0)) / nullif(count({0}), 0) as {0}".format(m)
    for m in METRICS
)
_AGED = "select *, row_number() over (order by year desc) as age from ann"
TAIL_SQL = f"select {_TAIL_ORDERED} from ({_AGED}) where age <= 3"


@query("win_tail3_mean", with_ctes(TAIL_SQL))
def win_tail3_mean(spark, root):
    return annual.tail_means(annual.annual_metrics(retail.facts(spark, root)))


def horizon_years(spark, root):
    """Years of the horizon dates, from the order dates alone."""
    return (
        retail.orders(spark, root)
        .filter(F.col("order_date") >= F.lit(SPLIT).cast("date"))
        .select(F.year("order_date").alias("year"))
        .distinct()
    )


@query(
    "srt_horizon_years",
    f"""select distinct cast(year(o_orderdate) as integer) as year from orders
        where o_orderdate >= timestamp '{SPLIT}' order by 1""",
)
def srt_horizon_years(spark, root):
    return horizon_years(spark, root).orderBy("year")


@query(
    "jn_missing_years",
    with_ctes(
        "select year from hy where year not in (select year from ann)",
        {**TRAIN_FACTS, "hy": "select distinct cast(year(date) as integer) as year from horizon"},
    ),
)
def jn_missing_years(spark, root):
    known = annual.order_counts(retail.facts(spark, root).before(SPLIT).orders)
    return annual.missing_years(horizon_years(spark, root), known)


@query(
    "annual_extrapolated",
    with_ctes(
        f"""select year, {_ANN} from ann
            union all
            select hy.year, {_ANN} from hy, tail where hy.year not in (select year from ann)""",
        {
            **TRAIN_FACTS,
            "hy": "select distinct cast(year(date) as integer) as year from horizon",
            "tail": TAIL_SQL,
        },
    ),
)
def annual_extrapolated(spark, root):
    metrics = annual.annual_metrics(retail.facts(spark, root).before(SPLIT))
    return annual.extrapolate(metrics, horizon_years(spark, root))


@query("agg_daily_sales", with_ctes("select date, revenue, cogs from daily"))
def agg_daily_sales(spark, root):
    return retail.daily_sales(spark, root)


@query("agg_annual_totals", with_ctes("select year, revenue, cogs from totals"))
def agg_annual_totals(spark, root):
    return growth.annual_totals(train(spark, root))


def train(spark, root, keys=None):
    """Daily sales of the training years, for a plan that reads them once."""
    daily = retail.daily_sales(spark, root, keys)
    return daily.filter(F.col("date") < F.lit(SPLIT).cast("date"))


def history(spark, root, keys=None):
    """Daily sales of the training years, rolled up once for plans that read them often."""
    return stage(train(spark, root, keys), "history")


def split(spark, root, keys=None):
    """Training years and the dates to forecast, from one roll-up of the facts."""
    daily = stage(retail.daily_sales(spark, root, keys), "daily")
    cut = F.lit(SPLIT).cast("date")
    return (
        daily.filter(F.col("date") < cut),
        daily.filter(F.col("date") >= cut).drop("revenue", "cogs"),
    )


_LINES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "agg_line_medians",
    "select " + ", ".join(f"round(median({c}), 6) as {c}" for c in _LINES) + " from lineitem",
)
def agg_line_medians(spark, root):
    """Exact medians over all lines, whose distinct values grow with the table."""
    found = quantiles.exact_medians(retail.table(spark, root, "lineitem"), _LINES)
    return found.select(*[F.round(c, 6).alias(c) for c in _LINES])


_SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


@query(
    "agg_line_quantiles",
    " union all ".join(
        f"select {s}::double as share, "
        + ", ".join(f"round(quantile_cont({c}, {s}), 6) as {c}" for c in _LINES)
        + " from lineitem"
        for s in _SHARES
    ),
)
def agg_line_quantiles(spark, root):
    found = quantiles.exact_quantiles(retail.table(spark, root, "lineitem"), _LINES, _SHARES)
    return found.select("share", *[F.round(c, 6).alias(c) for c in _LINES])
