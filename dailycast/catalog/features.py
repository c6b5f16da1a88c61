"""Feature operators over the daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailycast.catalog.facts import history, split, train
from dailycast.catalog.registry import query
from dailycast.catalog.sql import METRICS, SPLIT, TRAIN_FACTS, mavg, msum, with_ctes
from dailycast.functions.calendar import with_calendar
from dailycast.operators import folds, growth, impute, lags, seasonal
from dailycast.operators.attach import attach_row, attach_stats
from dailycast.plans.features import build_features
from dailycast.sources import retail
from dailycast.sources.staging import stage

MD = ["hist_monthday_revenue_mean", "hist_monthday_cogs_mean"]
MD2 = ["hist_monthday_revenue_mean_2y", "hist_monthday_cogs_mean_2y"]
MO = ["hist_month_revenue_mean", "hist_month_cogs_mean"]
WD = ["hist_weekday_revenue_mean", "hist_weekday_cogs_mean"]


@query("agg_monthday_mean", with_ctes("select * from md"))
def agg_monthday_mean(spark, root):
    return seasonal.monthday_means(train(spark, root))


@query("agg_monthday_mean_2y", with_ctes("select * from md2"))
def agg_monthday_mean_2y(spark, root):
    return seasonal.monthday_means_recent(history(spark, root))


@query("agg_month_mean", with_ctes("select * from mo"))
def agg_month_mean(spark, root):
    return seasonal.month_means(train(spark, root))


@query("agg_weekday_mean", with_ctes("select * from wd"))
def agg_weekday_mean(spark, root):
    return seasonal.weekday_means(train(spark, root))


@query(
    "flt_recent_years",
    with_ctes(
        "select date, revenue, cogs from train where year(date) >= (select max(year(date)) - 1 from train)"
    ),
)
def flt_recent_years(spark, root):
    return seasonal.recent(history(spark, root))


@query(
    "agg_bounds",
    with_ctes(
        """select min(date) as train_start, max(date) as train_end,
                  cast(max(year(date)) as integer) as max_year from train"""
    ),
)
def agg_bounds(spark, root):
    return seasonal.bounds(train(spark, root))


@query(
    "jn_scalar_broadcast",
    with_ctes(
        """select date, revenue, cogs, (select min(date) from train) as train_start,
                  (select cast(max(year(date)) as integer) from train) as max_year from daily"""
    ),
)
def jn_scalar_broadcast(spark, root):
    daily = stage(retail.daily_sales(spark, root), "daily")
    known = daily.filter(F.col("date") < F.lit(SPLIT).cast("date"))
    return attach_row(daily, seasonal.bounds(known).select("train_start", "max_year"))


@query(
    "jn_seasonal_attach",
    with_ctes(
        """select date, revenue, cogs, month, day, weekday, md.* exclude (month, day),
                  md2.* exclude (month, day), mo.* exclude (month), wd.* exclude (weekday)
           from calendar left join md using (month, day) left join md2 using (month, day)
                left join mo using (month) left join wd using (weekday)"""
    ),
)
def jn_seasonal_attach(spark, root):
    sales = history(spark, root)
    rows = seasonal.attach_seasonal(with_calendar(sales), sales)
    return rows.select(
        "date", "revenue", "cogs", "month", "day", "weekday", *MD, *MD2, *MO, *WD
    )


@query(
    "jn_lag_365",
    with_ctes("select date, lag_1y_revenue, lag_1y_cogs from horizon left join lags using (date)"),
)
def jn_lag_365(spark, root):
    sales, ahead = split(spark, root)
    return lags.attach_lag(ahead, sales)


@query(
    "imp_lag_fallback_horizon",
    with_ctes(
        """select date,
                  case when lag_1y_revenue is null then hist_monthday_revenue_mean_2y
                       else lag_1y_revenue end as lag_1y_revenue,
                  case when lag_1y_revenue is null then hist_monthday_cogs_mean_2y
                       else lag_1y_cogs end as lag_1y_cogs
           from hcalendar left join lags using (date) left join md2 using (month, day)"""
    ),
)
def imp_lag_fallback_horizon(spark, root):
    sales, ahead = split(spark, root)
    rows = attach_stats(
        with_calendar(ahead),
        seasonal.monthday_means_recent(sales),
        ["month", "day"],
    )
    return lags.fill_horizon_lag(lags.attach_lag(rows, sales)).select(
        "date", "lag_1y_revenue", "lag_1y_cogs"
    )


@query(
    "imp_lag_fallback_train",
    with_ctes(
        """select date, coalesce(lag_1y_revenue, hist_monthday_revenue_mean) as lag_1y_revenue,
                  coalesce(lag_1y_cogs, hist_monthday_cogs_mean) as lag_1y_cogs
           from calendar left join lags using (date) left join md using (month, day)"""
    ),
)
def imp_lag_fallback_train(spark, root):
    sales = history(spark, root)
    rows = attach_stats(with_calendar(sales), seasonal.monthday_means(sales), ["month", "day"])
    return lags.fill_history_lag(lags.attach_lag(rows, sales)).select(
        "date", "lag_1y_revenue", "lag_1y_cogs"
    )


@query(
    "win_yoy_growth",
    with_ctes("select year, hist_yoy_revenue_growth, hist_yoy_cogs_growth from yoy"),
)
def win_yoy_growth(spark, root):
    return growth.yoy_growth(train(spark, root)).select(
        "year", "hist_yoy_revenue_growth", "hist_yoy_cogs_growth"
    )


@query(
    "win_yoy_growth_3y",
    with_ctes("select year, hist_yoy_rev_growth_3y, hist_yoy_cogs_growth_3y from yoy"),
)
def win_yoy_growth_3y(spark, root):
    return growth.yoy_growth(train(spark, root)).select(
        "year", "hist_yoy_rev_growth_3y", "hist_yoy_cogs_growth_3y"
    )


@query("win_latest_growth", with_ctes("select * from latest"))
def win_latest_growth(spark, root):
    return growth.latest_growth(growth.yoy_growth(train(spark, root)))


_LAGGED = "select date, lag_1y_revenue, lag_1y_cogs from horizon left join lags using (date)"
_LAGGED_T = "select date, lag_1y_revenue, lag_1y_cogs from train left join lags using (date)"
LAGS = ["lag_1y_revenue", "lag_1y_cogs"]


@query(
    "agg_medians",
    with_ctes(
        """select median(lag_1y_revenue) as lag_1y_revenue, median(lag_1y_cogs) as lag_1y_cogs
           from lagged""",
        {"lagged": _LAGGED_T},
    ),
)
def agg_medians(spark, root):
    sales = history(spark, root)
    return impute.medians(lags.attach_lag(sales, sales), LAGS)


@query(
    "imp_median_self",
    with_ctes(
        """select date, coalesce(lag_1y_revenue, (select median(lag_1y_revenue) from lagged))
                    as lag_1y_revenue,
                  coalesce(lag_1y_cogs, (select median(lag_1y_cogs) from lagged)) as lag_1y_cogs
           from lagged""",
        {"lagged": _LAGGED},
    ),
)
def imp_median_self(spark, root):
    sales, ahead = split(spark, root)
    rows = lags.attach_lag(ahead, sales)
    return impute.fill_own_median(rows, LAGS)


@query(
    "imp_median_then_zero",
    with_ctes(
        """select date, coalesce(lag_1y_revenue, (select median(lag_1y_revenue) from lagged_t), 0)
                    as lag_1y_revenue,
                  coalesce(lag_1y_cogs, (select median(lag_1y_cogs) from lagged_t), 0)
                    as lag_1y_cogs
           from lagged""",
        {"lagged": _LAGGED, "lagged_t": _LAGGED_T},
    ),
)
def imp_median_then_zero(spark, root):
    sales, ahead = split(spark, root)
    rows = lags.attach_lag(ahead, sales)
    return impute.fill_train_median(rows, lags.attach_lag(sales, sales), LAGS)


_INF = """
    select date, case when cogs > revenue * 0.6 then 'infinity'::double
                      when cogs < revenue * 0.3 then null
                      else revenue / cogs end as markup
    from train"""


@query(
    "imp_inf",
    with_ctes(
        """select date, coalesce(case when markup = 'infinity'::double then null else markup end,
                                 (select median(markup) from marked), 0) as markup
           from marked""",
        {"marked": _INF},
    ),
)
def imp_inf(spark, root):
    markup = (
        F.when(F.col("cogs") > F.col("revenue") * 0.6, F.lit(float("inf")))
        .when(F.col("cogs") < F.col("revenue") * 0.3, F.lit(None).cast("double"))
        .otherwise(F.try_divide("revenue", "cogs"))
    )
    rows = history(spark, root).select("date", markup.alias("markup"))
    return impute.fill_train_median(rows, rows, ["markup"], clear_infinite=True)


FOLD_SQL = {
    "pos": "select date, row_number() over (order by date) - 1 as position from train",
    "sized": "select *, (select count(*) from pos) as n from pos",
    "folds": """
        select date, position,
               cast(case when position < n - 5 * (n // 6) then 0
                    else (position - (n - 5 * (n // 6))) // (n // 6) + 1 end as integer) as fold
        from sized""",
    "bounds": """
        select f.fold, (select min(date) from folds) as train_start,
               (select max(date) from folds g where g.fold < f.fold) as train_end,
               min(f.date) as val_start, max(f.date) as val_end
        from folds f where f.fold > 0 group by 1""",
}


@query("scan_sorted_position", with_ctes(
    "select date, revenue, cogs, row_number() over (order by date) - 1 as position from daily"
))
def scan_sorted_position(spark, root):
    return folds.with_position(stage(retail.daily_sales(spark, root), "daily"))


def train_dates(spark, root):
    return history(spark, root).select("date")


@query("ts_fold_assign", with_ctes("select date, position, fold from folds", FOLD_SQL))
def ts_fold_assign(spark, root):
    return folds.assign_folds(train_dates(spark, root))


@query(
    "ts_fold_bounds",
    with_ctes("select fold, train_start, train_end, val_start, val_end from bounds", FOLD_SQL),
)
def ts_fold_bounds(spark, root):
    return folds.fold_bounds(folds.assign_folds(train_dates(spark, root)))


@query(
    "jn_fold_interval",
    with_ctes(
        """select t.date, t.revenue, t.cogs, b.fold
           from train t join bounds b on t.date between b.val_start and b.val_end""",
        FOLD_SQL,
    ),
)
def jn_fold_interval(spark, root):
    sales = history(spark, root)
    return folds.in_fold_range(sales, folds.fold_bounds(folds.assign_folds(sales)))


# --- the whole feature build -------------------------------------------------

_FILLED = [
    *MD, *MD2, *MO, *WD, *LAGS, *growth.GROWTH_COLS, *METRICS,
]
_EXACT = ["month", "year", "quarter", "days_since_start", "dayofyear", "weekday", "day"]
FEATURE_SQL = {
    **TRAIN_FACTS,
    "hy": "select distinct cast(year(date) as integer) as year from horizon",
    "aged": "select *, row_number() over (order by year desc) as age from ann",
    "tail": "select " + ", ".join(
        "(coalesce(max({0}) filter (age = 3), 0) + coalesce(max({0}) filter (age = 2), 0)"
        " + coalesce(max({0}) filter (age = 1), 0)) / nullif(count({0}), 0) as {0}".format(m)
        for m in METRICS
    ) + " from aged where age <= 3",
    "annx": f"""
        select year, {", ".join(METRICS)} from ann
        union all
        select hy.year, {", ".join(METRICS)} from hy, tail
        where hy.year not in (select year from ann)""",
    "raw_train": """
        select c.*, md.* exclude (month, day), md2.* exclude (month, day), mo.* exclude (month),
               wd.* exclude (weekday),
               coalesce(l.lag_1y_revenue, hist_monthday_revenue_mean) as lag_1y_revenue,
               coalesce(l.lag_1y_cogs, hist_monthday_cogs_mean) as lag_1y_cogs,
               y.* exclude (year, revenue, cogs), a.* exclude (year)
        from calendar c left join md on c.month = md.month and c.day = md.day
             left join md2 on c.month = md2.month and c.day = md2.day
             left join mo on c.month = mo.month left join wd on c.weekday = wd.weekday
             left join lags l on c.date = l.date
             left join yoy y on c.year = y.year left join annx a on c.year = a.year""",
    "raw_horizon": """
        select c.*, md.* exclude (month, day), md2.* exclude (month, day), mo.* exclude (month),
               wd.* exclude (weekday),
               case when l.lag_1y_revenue is null then hist_monthday_revenue_mean_2y
                    else l.lag_1y_revenue end as lag_1y_revenue,
               case when l.lag_1y_revenue is null then hist_monthday_cogs_mean_2y
                    else l.lag_1y_cogs end as lag_1y_cogs,
               g.*, a.* exclude (year)
        from hcalendar c left join md on c.month = md.month and c.day = md.day
             left join md2 on c.month = md2.month and c.day = md2.day
             left join mo on c.month = mo.month left join wd on c.weekday = wd.weekday
             left join lags l on c.date = l.date
             cross join latest g left join annx a on c.year = a.year""",
}


def _feature_body(raw: str) -> str:
    filled = ", ".join(f"coalesce({c}, (select median({c}) from {raw})) as {c}" for c in _FILLED)
    return f"""
        select date, {filled}, {", ".join(c for c in _EXACT if c != "days_since_start")},
               cast(date - (select min(date) from train) as integer) as days_since_start,
               (date - (select min(date) from train))::bigint
                 * (date - (select min(date) from train))::bigint as days_since_start_sq,
               (year - 2012)::bigint * (year - 2012)::bigint as year_sq,
               round(sin(2 * pi() * dayofyear / 365.25), 9) as day_sin,
               round(cos(2 * pi() * dayofyear / 365.25), 9) as day_cos
        from {raw}"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("day_sin", "day_cos")})


def feature_set(spark, root, keys=None):
    sales, ahead = split(spark, root, keys)
    facts = None if keys else retail.facts(spark, root).before(SPLIT)
    return build_features(sales, ahead, facts, keys=list(keys or ()), stage_inputs=False)


@query("feat_train", with_ctes(_feature_body("raw_train"), FEATURE_SQL))
def feat_train(spark, root):
    return _rounded(feature_set(spark, root).train)


@query("feat_horizon", with_ctes(_feature_body("raw_horizon"), FEATURE_SQL))
def feat_horizon(spark, root):
    return _rounded(feature_set(spark, root).horizon)


@query("feat_target", with_ctes("select date, revenue, cogs from train"))
def feat_target(spark, root):
    return train(spark, root)


# --- many series at once -----------------------------------------------------

SEGMENTS = {"segment": ("customer", "c_mktsegment")}
SEGMENT_SQL = {
    "sdaily": f"""
        select c_mktsegment as segment, cast(o_orderdate as date) as date,
               {msum("l_extendedprice * (1 - l_discount)")} as revenue,
               {msum("l_quantity * p_retailprice")} as cogs
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
             join customer on o_custkey = c_custkey
        group by 1, 2""",
    "strain": f"select * from sdaily where date < date '{SPLIT}'",
    "shorizon": f"select segment, date from sdaily where date >= date '{SPLIT}'",
    "smax": "select segment, max(year(date)) as max_year from strain group by 1",
    "smd": f"""
        select segment, month(date) as m, day(date) as d, {mavg("revenue")} as r, {mavg("cogs")} as c
        from strain group by 1, 2, 3""",
    "smd2": f"""
        select segment, month(date) as m, day(date) as d, {mavg("revenue")} as r, {mavg("cogs")} as c
        from strain join smax using (segment) where year(date) >= max_year - 1 group by 1, 2, 3""",
    "syear": f"""
        select segment, cast(year(date) as integer) as year, {msum("revenue")} as revenue
        from strain group by 1, 2""",
    "syoy": """
        select segment, year, revenue / nullif(lag(revenue) over w, 0) - 1 as g
        from syear window w as (partition by segment order by year)""",
    "slatest": "select segment, arg_max(g, year) as g from (select segment, year, coalesce(g, 'nan'::double) as g from syoy) group by 1",
    "sraw": """
        select h.segment, h.date,
               case when l.revenue is null then smd2.r else l.revenue end as lag_1y_revenue,
               case when l.revenue is null then smd2.c else l.cogs end as lag_1y_cogs,
               smd.r as hist_monthday_revenue_mean, slatest.g as hist_yoy_revenue_growth
        from shorizon h
             left join strain l on l.segment = h.segment and l.date + 365 = h.date
             left join smd on smd.segment = h.segment and smd.m = month(h.date) and smd.d = day(h.date)
             left join smd2 on smd2.segment = h.segment and smd2.m = month(h.date)
                           and smd2.d = day(h.date)
             left join slatest on slatest.segment = h.segment""",
}
_SEG_COLS = ["lag_1y_revenue", "lag_1y_cogs", "hist_monthday_revenue_mean"]


@query(
    "feat_horizon_by_segment",
    with_ctes(
        "select segment, date, hist_yoy_revenue_growth, "
        + ", ".join(f"coalesce({c}, median({c}) over (partition by segment)) as {c}" for c in _SEG_COLS)
        + " from sraw",
        SEGMENT_SQL,
    ),
)
def feat_horizon_by_segment(spark, root):
    """Every market segment as its own series, in one plan."""
    return feature_set(spark, root, SEGMENTS).horizon.select(
        "segment", "date", "hist_yoy_revenue_growth", *_SEG_COLS
    )


@query("agg_daily_sales_by_segment", with_ctes("select * from sdaily", SEGMENT_SQL))
def agg_daily_sales_by_segment(spark, root):
    return retail.daily_sales(spark, root, SEGMENTS)
