"""SQL fragments shared by the checks; written independently of the operators."""

from __future__ import annotations

SPLIT = "2000-01-01"


def msum(x: str) -> str:
    """Total of amounts as DOUBLE: a sum of whole multiples of 2^-60, which the given amounts are, rounded once."""
    total = f"coalesce(sum(({x} * 1152921504606846976.0::double)::hugeint), 0)::hugeint"
    return f"((({total} // 1099511627776)::double * 1099511627776.0 + ({total} % 1099511627776)::double) / 1152921504606846976.0)"


def mavg(x: str) -> str:
    return f"({msum(x)} / nullif(count({x}), 0))"


# Base relations. Each may use the ones above it.
CTES: dict[str, str] = {
    "daily": f"""
        select cast(o_orderdate as date) as date,
               {msum("l_extendedprice * (1 - l_discount)")} as revenue,
               {msum("l_quantity * p_retailprice")} as cogs
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
        group by 1""",
    "train": f"select * from daily where date < date '{SPLIT}'",
    "horizon": f"select date from daily where date >= date '{SPLIT}'",
    "o": """
        select o_orderkey as order_id, o_custkey as customer_id,
               cast(o_orderdate as date) as order_date,
               cast(year(o_orderdate) as integer) as year
        from orders""",
    "items": """
        select l_orderkey as order_id, l_quantity as quantity,
               l_extendedprice / l_quantity as unit_price,
               l_extendedprice * l_discount as discount_amount
        from lineitem""",
    "returned": "select l_orderkey as order_id from lineitem where l_returnflag = 'R'",
    "traffic": """
        select cast(l_shipdate as date) as date, count(*) as sessions
        from lineitem group by 1""",
    "oy": "select distinct order_id, year from o",
    "first_years": """
        select customer_id, min(year) as first_year from o
        where customer_id is not null group by 1""",
    "counts": """
        select o.year, count(distinct o.customer_id) as customers, count(*) as n,
               avg(case when o.year = f.first_year then 1.0::double else 0.0::double end) as new_rate
        from o left join first_years f on o.customer_id = f.customer_id
        group by 1""",
    "vals": f"""
        select year, {msum("quantity * unit_price")} as total_value,
               {msum("discount_amount")} as total_discount
        from items join oy using (order_id) group by 1""",
    "rets": """
        select year, count(distinct order_id) as returned_orders
        from returned join oy using (order_id) group by 1""",
    "sess": """
        select cast(year(date) as integer) as year, sum(sessions)::bigint as annual_sessions
        from traffic group by 1""",
    "sessg": """
        select year, annual_sessions,
               annual_sessions::double
                 / nullif(lag(annual_sessions) over (order by year), 0)::double - 1
                 as annual_sessions_growth
        from sess""",
    "ann": """
        select c.year, c.customers::double as annual_unique_customers,
               c.n::double as annual_total_orders, c.new_rate as annual_new_customer_rate,
               v.total_value / nullif(c.n, 0)::double as annual_aov,
               v.total_discount / nullif(v.total_value, 0) as annual_discount_intensity,
               r.returned_orders::double / nullif(c.n, 0)::double as annual_return_rate,
               s.annual_sessions::double as annual_sessions, s.annual_sessions_growth
        from counts c left join vals v using (year) left join rets r using (year)
             left join sessg s using (year)""",
    "calendar": """
        select *, cast(month(date) as integer) as month, cast(day(date) as integer) as day,
               cast(isodow(date) - 1 as integer) as weekday,
               cast(dayofyear(date) as integer) as dayofyear,
               cast(year(date) as integer) as year, cast(quarter(date) as integer) as quarter
        from train""",
    "hcalendar": """
        select *, cast(month(date) as integer) as month, cast(day(date) as integer) as day,
               cast(isodow(date) - 1 as integer) as weekday,
               cast(dayofyear(date) as integer) as dayofyear,
               cast(year(date) as integer) as year, cast(quarter(date) as integer) as quarter
        from horizon""",
    "md": f"""
        select month, day, {mavg("revenue")} as hist_monthday_revenue_mean,
               {mavg("cogs")} as hist_monthday_cogs_mean
        from calendar group by 1, 2""",
    "md2": f"""
        select month, day, {mavg("revenue")} as hist_monthday_revenue_mean_2y,
               {mavg("cogs")} as hist_monthday_cogs_mean_2y
        from calendar where year >= (select max(year) - 1 from calendar) group by 1, 2""",
    "mo": f"""
        select month, {mavg("revenue")} as hist_month_revenue_mean,
               {mavg("cogs")} as hist_month_cogs_mean
        from calendar group by 1""",
    "wd": f"""
        select weekday, {mavg("revenue")} as hist_weekday_revenue_mean,
               {mavg("cogs")} as hist_weekday_cogs_mean
        from calendar group by 1""",
    "totals": f"""
        select year, {msum("revenue")} as revenue, {msum("cogs")} as cogs
        from calendar group by 1""",
    "yoy1": """
        select *, revenue / nullif(lag(revenue) over (order by year), 0) - 1
                    as hist_yoy_revenue_growth,
               cogs / nullif(lag(cogs) over (order by year), 0) - 1 as hist_yoy_cogs_growth
        from totals""",
    "yoy": """
        select *, avg(hist_yoy_revenue_growth) over w as hist_yoy_rev_growth_3y,
               avg(hist_yoy_cogs_growth) over w as hist_yoy_cogs_growth_3y
        from yoy1 window w as (order by year rows between 2 preceding and current row)""",
    "latest": """
        select hist_yoy_revenue_growth, hist_yoy_cogs_growth,
               hist_yoy_rev_growth_3y, hist_yoy_cogs_growth_3y
        from yoy order by year desc limit 1""",
    "lags": """
        select date + 365 as date, revenue as lag_1y_revenue, cogs as lag_1y_cogs from train""",
}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with every base relation, plus ``extra`` ones after them."""
    ctes = {**CTES, **(extra or {})}
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in ctes.items()) + "\n" + body


# What the facts look like when only the training years are known.
TRAIN_FACTS = {
    "o": CTES["o"] + f" where o_orderdate < timestamp '{SPLIT}'",
    "traffic": f"""
        select cast(l_shipdate as date) as date, count(*) as sessions
        from lineitem where l_shipdate < timestamp '{SPLIT}' group by 1""",
}

METRICS = [
    "annual_unique_customers",
    "annual_total_orders",
    "annual_new_customer_rate",
    "annual_aov",
    "annual_discount_intensity",
    "annual_return_rate",
    "annual_sessions",
    "annual_sessions_growth",
]
