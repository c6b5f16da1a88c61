"""Row-level expressions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailycast.catalog.facts import history, split, train
from dailycast.catalog.registry import query
from dailycast.catalog.sql import with_ctes
from dailycast.functions import calendar as cal
from dailycast.functions import metrics
from dailycast.functions import numeric as num
from dailycast.operators import stack
from dailycast.operators.attach import attach_row
from dailycast.operators.lags import attach_lag
from dailycast.sources import retail, sinks, tables
from dailycast.sources.staging import stage_path
from dailycast.sources.retail import table

_ORDERS = "select o_orderkey as order_id, cast(o_orderdate as date) as date from orders"


def order_dates(spark, root):
    return retail.orders(spark, root).select("order_id", F.col("order_date").alias("date"))


@query(
    "prj_calendar",
    f"""select order_id, date, cast(month(date) as integer) as month,
               cast(day(date) as integer) as day, cast(isodow(date) - 1 as integer) as weekday,
               cast(dayofyear(date) as integer) as dayofyear, cast(year(date) as integer) as year,
               cast(quarter(date) as integer) as quarter
        from ({_ORDERS})""",
)
def prj_calendar(spark, root):
    return cal.with_calendar(order_dates(spark, root))


@query(
    "prj_days_since_start",
    f"""with o as ({_ORDERS})
        select order_id, date,
               cast(date - (select min(date) from o) as integer) as days_since_start
        from o""",
)
def prj_days_since_start(spark, root):
    rows = order_dates(spark, root)
    start = rows.agg(F.min("date").alias("start"))
    return attach_row(rows, start).select(
        "order_id", "date", cal.days_since(F.col("start")).alias("days_since_start")
    )


@query(
    "prj_cyclic",
    f"""select order_id, round(sin(2 * pi() * dayofyear(date) / 365.25), 9) as day_sin,
               round(cos(2 * pi() * dayofyear(date) / 365.25), 9) as day_cos
        from ({_ORDERS})""",
)
def prj_cyclic(spark, root):
    rows = order_dates(spark, root).withColumn("dayofyear", F.dayofyear("date"))
    parts = cal.cyclic_parts()
    return rows.select("order_id", *[F.round(c, 9).alias(n) for n, c in parts.items()])


@query(
    "prj_trend",
    f"""with o as ({_ORDERS}),
             d as (select order_id, (date - (select min(date) from o))::bigint as n,
                          year(date)::bigint - 2012 as y from o)
        select order_id, n * n as days_since_start_sq, y * y as year_sq from d""",
)
def prj_trend(spark, root):
    rows = order_dates(spark, root)
    start = rows.agg(F.min("date").alias("start"))
    rows = attach_row(rows, start).withColumns(
        {"days_since_start": cal.days_since(F.col("start")), "year": F.year("date")}
    )
    return rows.withColumns(cal.trend_parts()).select("order_id", "days_since_start_sq", "year_sq")


@query("prj_shift_365", f"select order_id, date, date + 365 as lag_date from ({_ORDERS})")
def prj_shift_365(spark, root):
    return order_dates(spark, root).withColumn("lag_date", cal.shift_days("date"))


@query(
    "prj_drop",
    "select o_orderkey, o_custkey, o_totalprice from orders",
)
def prj_drop(spark, root):
    return table(spark, root, "orders").drop(
        "o_orderstatus", "o_orderpriority", "o_orderdate", "not_there"
    )


@query(
    "prj_log_target",
    """select o_orderkey as order_id, round(ln(1 + o_totalprice), 9) as log_price from orders""",
)
def prj_log_target(spark, root):
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.round(num.log_target("o_totalprice"), 9).alias("log_price"),
    )


@query(
    "prj_safe_expm1",
    """select o_orderkey as order_id,
              round(greatest(exp(greatest(least(o_totalprice / 100000 - 1, 20), -20)) - 1, 0), 6)
                as amount,
              round(exp(greatest(least(o_totalprice / 10000 - 25, 20), -20)) - 1, 1) as clipped
       from orders""",
)
def prj_safe_expm1(spark, root):
    price = F.col("o_totalprice")
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.round(num.unlog(price / 100000 - 1), 6).alias("amount"),
        F.round(num.clipped_expm1(price / 10000 - 25), 1).alias("clipped"),
    )


@query(
    "prj_margin_cap",
    with_ctes(
        """select date, least(greatest(cogs * 2, 0), 0.995::double * greatest(revenue, 0)) as cogs
           from daily"""
    ),
)
def prj_margin_cap(spark, root):
    return retail.daily_sales(spark, root).select(
        "date", num.cap_to_margin(F.col("cogs") * 2, "revenue").alias("cogs")
    )


@query(
    "prj_forecast_format",
    with_ctes(
        """select strftime(date, '%Y-%m-%d') as Date, round_even(revenue / 7, 2) as Revenue,
                  round_even(cogs / 7, 2) as COGS from daily"""
    ),
)
def prj_forecast_format(spark, root):
    daily = retail.daily_sales(spark, root)
    return stack.format_forecast(daily.select("date", F.col("revenue") / 7, F.col("cogs") / 7).toDF("date", "revenue", "cogs"))


@query(
    "prj_align_schema",
    """select o_totalprice, cast(null as double) as absent, o_orderkey from orders""",
)
def prj_align_schema(spark, root):
    return tables.align_columns(
        table(spark, root, "orders"), ["o_totalprice", "absent", "o_orderkey"]
    )


@query(
    "flt_finite_pairs",
    """select o_orderkey as order_id, actual, pred from (
         select o_orderkey, o_totalprice as actual,
                case when o_orderpriority = '1-URGENT' then 'nan'::double
                     when o_orderpriority = '5-LOW' then 'infinity'::double
                     when o_orderpriority = '2-HIGH' then null
                     else o_totalprice * 2 end as pred from orders)
       where isfinite(actual) and isfinite(pred)""",
)
def flt_finite_pairs(spark, root):
    priority = F.col("o_orderpriority")
    pred = (
        F.when(priority == "1-URGENT", F.lit(float("nan")))
        .when(priority == "5-LOW", F.lit(float("inf")))
        .when(priority == "2-HIGH", F.lit(None).cast("double"))
        .otherwise(F.col("o_totalprice") * 2)
    )
    rows = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("actual"),
        pred.alias("pred"),
    )
    return metrics.finite_pairs(rows)


@query(
    "prj_row_mean",
    with_ctes(
        """select date,
                  (coalesce(lag_1y_revenue, 0) + coalesce(lag_1y_cogs, 0) + revenue)
                    / ((lag_1y_revenue is not null)::int + (lag_1y_cogs is not null)::int + 1)
                    as row_mean
           from train left join lags using (date)"""
    ),
)
def prj_row_mean(spark, root):
    sales = history(spark, root)
    return attach_lag(sales, sales).select(
        "date", num.row_mean("lag_1y_revenue", "lag_1y_cogs", "revenue").alias("row_mean")
    )


@query(
    "prj_casts",
    """select l_orderkey as order_id, l_linenumber as line,
              cast(l_returnflag = 'R' as integer) as is_returned,
              cast(l_linenumber as double) as line_double, cast(l_shipdate as date) as ship_date,
              try_cast(l_returnflag as double) as flag_number
       from lineitem""",
)
def prj_casts(spark, root):
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_returned"),
        F.col("l_linenumber").cast("double").alias("line_double"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
        F.col("l_returnflag").try_cast("double").alias("flag_number"),
    )


@query("src_csv_roundtrip", "select o_orderkey::varchar as order_id, o_custkey::varchar as customer_id, cast(o_orderdate as date) as order_date from orders")
def src_csv_roundtrip(spark, root):
    path = stage_path(spark, "orders_csv")
    sinks.write_table(retail.orders(spark, root), path, "csv")
    return tables.read_table(spark, path, tables.ORDERS, "csv")


@query("snk_features_roundtrip", with_ctes("select date, revenue, cogs from train"))
def snk_features_roundtrip(spark, root):
    path = stage_path(spark, "sales_csv")
    sales = train(spark, root).toDF("Date", "Revenue", "COGS")
    sinks.write_table(sales, path, "csv")
    return tables.read_sales(spark, path, "csv")


@query(
    "src_header_normalize",
    with_ctes("select date, revenue as Revenue, cogs as COGS from daily"),
)
def src_header_normalize(spark, root):
    raw = retail.daily_sales(spark, root).toDF("date", "net_revenue", "Cogs")
    return tables.canonical_targets(raw)


@query("src_leak_guard", with_ctes("select date, month, day from calendar"))
def src_leak_guard(spark, root):
    leaky = cal.with_calendar(train(spark, root)).select(
        "date",
        "month",
        F.col("revenue").alias("Revenue"),
        "day",
        F.col("cogs").alias("COGS"),
    )
    return tables.drop_leaks(leaky)


@query("src_attach_target", with_ctes("select date, month, day, revenue, cogs from calendar"))
def src_attach_target(spark, root):
    sales = history(spark, root)
    features = cal.with_calendar(sales.select("date")).select("date", "month", "day")
    return tables.attach_target(features, sales)


@query(
    "jn_positional_as_date",
    with_ctes(
        """select f.date, f.dayofyear, t.revenue, t.cogs
           from (select *, row_number() over (order by date) as i from calendar) f
           join (select *, row_number() over (order by date) as i from train) t using (i)"""
    ),
)
def jn_positional_as_date(spark, root):
    sales = history(spark, root)
    features = cal.with_calendar(sales.select("date")).select("date", "dayofyear")
    return features.join(sales, "date")


@query(
    "agg_data_checks",
    with_ctes(
        """select count(*) as n_rows, count(*) filter (lag_1y_revenue is null) as n_missing,
                  bool_or(lag_1y_revenue is null) as any_missing,
                  bool_or(lag_1y_revenue is not null and isfinite(lag_1y_revenue)) as any_finite,
                  count(*) = 0 as is_empty
           from horizon left join lags using (date)"""
    ),
)
def agg_data_checks(spark, root):
    sales, ahead = split(spark, root)
    rows = attach_lag(ahead, sales)
    lag = F.col("lag_1y_revenue")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(lag.isNull()).alias("n_missing"),
        F.bool_or(lag.isNull()).alias("any_missing"),
        F.bool_or(num.is_finite(lag)).alias("any_finite"),
        (F.count(F.lit(1)) == 0).alias("is_empty"),
    )
