"""Scores and stack tables over deterministic base forecasts.

Three simple forecasts stand in for fitted models, so that everything after the
fit can be compared with SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dailycast.catalog.facts import history, split
from dailycast.catalog.features import FOLD_SQL
from dailycast.catalog.registry import query
from dailycast.catalog.sql import with_ctes
from dailycast.functions import numeric as num
from dailycast.functions.calendar import with_calendar
from dailycast.functions.metrics import mape, r2
from dailycast.operators import folds, lags, ranking, scoring, seasonal
from dailycast.operators.attach import attach_stats
from dailycast.operators.stack import pick_variant
from dailycast.sources import retail
from dailycast.sources.staging import stage

MODELS = {
    "lag_1y": ("lag_1y_revenue", "lag_1y_cogs"),
    "monthday_mean": ("hist_monthday_revenue_mean", "hist_monthday_cogs_mean"),
    "month_mean": ("hist_month_revenue_mean", "hist_month_cogs_mean"),
}

BASE_SQL = {
    **FOLD_SQL,
    "wide": """
        select c.date, c.revenue, c.cogs,
               coalesce(l.lag_1y_revenue, hist_monthday_revenue_mean) as lag_1y_revenue,
               coalesce(l.lag_1y_cogs, hist_monthday_cogs_mean) as lag_1y_cogs,
               hist_monthday_revenue_mean, hist_monthday_cogs_mean,
               hist_month_revenue_mean, hist_month_cogs_mean
        from calendar c left join md using (month, day) left join mo using (month)
             left join lags l on c.date = l.date""",
    "preds": " union all ".join(
        f"select date, '{m}' as model, '{t}' as target, {c} as pred, {t} as actual from wide"
        for m, cols in MODELS.items()
        for t, c in zip(("revenue", "cogs"), cols)
    ),
    "folded": "select p.*, f.fold from preds p join folds f using (date)",
    "oof": """
        select date, model, target, fold, actual, case when fold > 0 then pred else 0 end as pred
        from folded""",
    "apes": """
        select *, abs(actual - pred) / (abs(actual) + 1e-9) as ape,
               (actual - pred) * (actual - pred) as se from oof""",
}


def _r2(by: str, where: str) -> str:
    return f"""
        select {by}, round(avg(ape), 9) as mape,
               round(case when var_pop(actual) * count(*) < 1e-12
                          then case when sum(se) < 1e-12 then 1.0 else 0.0 end
                          else 1 - sum(se) / (var_pop(actual) * count(*)) end, 9) as r2
        from apes where {where} group by {by}"""


def base_wide(spark, root):
    """Actuals next to the three base forecasts, one row per training date."""
    sales = history(spark, root)
    rows = with_calendar(sales)
    rows = attach_stats(rows, seasonal.monthday_means(sales), ["month", "day"])
    rows = attach_stats(rows, seasonal.month_means(sales), ["month"])
    rows = lags.fill_history_lag(lags.attach_lag(rows, sales))
    return rows.select("date", "revenue", "cogs", *[c for cs in MODELS.values() for c in cs])


def base_folded(spark, root):
    wide = base_wide(spark, root)
    days = folds.assign_folds(wide.select("date")).select("date", "fold")
    return scoring.melt_predictions(wide.join(days, "date"), MODELS).join(days, "date")


def base_oof(spark, root):
    """Predictions with the unvalidated head set to zero."""
    return scoring.fill_head(base_folded(spark, root), 0.0)


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query(
    "met_mape",
    with_ctes("select model, target, round(avg(ape), 9) as mape from apes where fold > 0 group by 1, 2", BASE_SQL),
)
def met_mape(spark, root):
    rows = scoring.fill_head(base_folded(spark, root), None)
    return rounded(rows.groupBy("model", "target").agg(mape().alias("mape")), "mape")


@query(
    "met_r2",
    with_ctes(
        "select model, target, r2 from (" + _r2("model, target", "fold > 0") + ")", BASE_SQL
    ),
)
def met_r2(spark, root):
    rows = scoring.fill_head(base_folded(spark, root), None)
    return rounded(rows.groupBy("model", "target").agg(r2().alias("r2")), "r2")


@query("met_fold_scores", with_ctes(_r2("fold, model, target", "fold > 0"), BASE_SQL))
def met_fold_scores(spark, root):
    wide = stage(base_wide(spark, root), "base_wide")
    bounds = folds.fold_bounds(folds.assign_folds(wide.select("date")))
    tagged = folds.in_fold_range(scoring.melt_predictions(wide, MODELS), bounds)
    return rounded(scoring.fold_scores(tagged), "mape", "r2")


@query(
    "met_cv_summary",
    with_ctes(
        f"""select model, target, round(avg(mape), 9) as mape_mean,
                   round(stddev_samp(mape), 9) as mape_std, round(avg(r2), 9) as r2_mean,
                   round(stddev_samp(r2), 9) as r2_std
            from ({_r2("fold, model, target", "fold > 0")}) group by 1, 2""",
        BASE_SQL,
    ),
)
def met_cv_summary(spark, root):
    rows = scoring.fill_head(base_folded(spark, root), None)
    scores = rounded(scoring.fold_scores(rows), "mape", "r2")
    return rounded(
        scoring.cv_summary(scores), "mape_mean", "mape_std", "r2_mean", "r2_std"
    ).drop("model_target")


@query("prj_concat_label", with_ctes("select date, model || '_' || target as model_target from preds", BASE_SQL))
def prj_concat_label(spark, root):
    preds = scoring.melt_predictions(base_wide(spark, root), MODELS)
    return preds.select("date", F.concat_ws("_", "model", "target").alias("model_target"))


@query("met_oof_scores", with_ctes(_r2("model, target", "true"), BASE_SQL))
def met_oof_scores(spark, root):
    return rounded(scoring.oof_scores(base_oof(spark, root)), "mape", "r2")


@query(
    "stack_matrix",
    with_ctes(
        """select date, target, max(pred) filter (model = 'lag_1y') as lag_1y,
                  max(pred) filter (model = 'monthday_mean') as monthday_mean,
                  max(pred) filter (model = 'month_mean') as month_mean
           from oof group by 1, 2""",
        BASE_SQL,
    ),
)
def stack_matrix(spark, root):
    return scoring.stack_matrix(base_oof(spark, root), list(MODELS))


@query(
    "agg_fold_average",
    with_ctes(
        """select date, 'month_mean' as model, 'revenue' as target, round(avg(pred), 6) as pred
           from (select k, month, avg(revenue) as pred
                 from calendar join folds using (date) join ks on fold < k group by 1, 2)
                join hcalendar using (month) group by 1""",
        {**FOLD_SQL, "ks": "select unnest([1, 2, 3, 4, 5]) as k"},
    ),
)
def agg_fold_average(spark, root):
    sales, ahead = split(spark, root)
    days = folds.assign_folds(sales.select("date")).select("date", "fold")
    known = (
        with_calendar(sales)
        .join(days, "date")
        .withColumn("k", F.explode(F.sequence(F.col("fold") + 1, F.lit(folds.N_SPLITS + 1))))
        .filter(F.col("k") <= folds.N_SPLITS)
    )
    fitted = known.groupBy("k", "month").agg(num.money_mean("revenue").alias("pred"))
    ahead = with_calendar(ahead).select("date", "month")
    preds = ahead.join(F.broadcast(fitted), "month").select(  # 12 months x 5 folds
        "date", F.lit("month_mean").alias("model"), F.lit("revenue").alias("target"), "pred"
    )
    return scoring.average_folds(preds).withColumn("pred", F.round("pred", 6))


@query(
    "stack_pick_variant",
    with_ctes(
        """select model as variant, round(sum(mape), 9) as total_mape
           from (select model, target, avg(ape) as mape from apes group by 1, 2)
           where model in ('lag_1y', 'monthday_mean')
           group by 1 order by sum(mape), 1 limit 1""",
        BASE_SQL,
    ),
)
def stack_pick_variant(spark, root):
    scores = scoring.oof_scores(base_oof(spark, root)).withColumnRenamed("model", "variant")
    return rounded(pick_variant(scores, ["lag_1y", "monthday_mean"]), "total_mape")


_CORR = """
    select target as source, model as feature, abs(corr(pred, actual)) as score
    from preds group by 1, 2"""


def base_association(spark, root):
    """Absolute correlation of each base forecast with each target, as a score table."""
    preds = scoring.melt_predictions(base_wide(spark, root), MODELS)
    return preds.groupBy(F.col("target").alias("source"), F.col("model").alias("feature")).agg(
        F.abs(F.corr("pred", "actual")).alias("score")
    )


@query(
    "imp_normalize",
    with_ctes(
        """select source, feature, round(score / sum(score) over (partition by source), 9) as score
           from corrs""",
        {**BASE_SQL, "corrs": _CORR},
    ),
)
def imp_normalize(spark, root):
    return rounded(ranking.normalize(base_association(spark, root)), "score")


@query(
    "imp_ranked",
    with_ctes(
        """select source, feature, round(score, 9) as score from corrs
           order by score desc, feature""",
        {**BASE_SQL, "corrs": _CORR},
    ),
)
def imp_ranked(spark, root):
    return ranking.ranked(rounded(base_association(spark, root), "score"), "score")


@query(
    "imp_top_k",
    with_ctes(
        """select source, feature, round(score, 9) as score from corrs
           order by score desc, feature limit 3""",
        {**BASE_SQL, "corrs": _CORR},
    ),
)
def imp_top_k(spark, root):
    return ranking.top_k(rounded(base_association(spark, root), "score"), "score", 3)


@query(
    "smp_fixed_size",
    """select o_orderkey, o_totalprice from orders
       order by md5(o_orderkey::varchar || '|42'), o_orderkey limit 500""",
)
def smp_fixed_size(spark, root):
    rows = retail.table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    return ranking.sample_rows(rows, ["o_orderkey"], 500)
