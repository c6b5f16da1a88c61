"""Fitted models over the daily features.

Most fits are not expressible in SQL, so these queries have no SQL check; closed
forms, additivity and planted signals are tested instead. Forests fitted on the
whole history and all meta-learners run at full size; boosted models and whole runs
take the full steps with few trees. ``ForecastConfig()`` and ``ImportanceConfig()``
hold the full-size settings.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from dailycast.catalog.features import feature_set
from dailycast.catalog.facts import split
from dailycast.catalog.forecasts import BASE_SQL, MODELS, base_oof, base_wide
from dailycast.catalog.registry import query
from dailycast.catalog.sql import with_ctes
from dailycast.functions.calendar import with_calendar
from dailycast.operators import attribution, lags, ranking, scoring, seasonal, stack, trees
from dailycast.operators.attach import attach_stats
from dailycast.plans import forecast as fc
from dailycast.plans import importance as imp
from dailycast.sources import sinks
from dailycast.sources.staging import stage, stage_path
from dailycast.sources.tables import attach_target

FULL = fc.ForecastConfig()
CONFIG = replace(fc.small_config(), meta_rounds=FULL.meta_rounds)
FULL_IMPORTANCE = imp.ImportanceConfig()
IMPORTANCE = imp.small_config()


def matrix(spark, root, n_splits=CONFIG.n_splits):
    """The model matrix of the training years and the horizon."""
    fs = feature_set(spark, root)
    train = attach_target(fs.train, fs.target)
    return fc.build_matrix(train, fs.horizon, fs.columns, n_splits=n_splits)


def fitted(spark, root, spec, target="revenue"):
    """Matrix and a model of the given kind fitted on the whole history."""
    m = matrix(spark, root)
    return m, trees.fit(m.train, f"log_{target}", spec)


def horizon_predictions(m, model):
    scored = model.transform(m.horizon)
    return scored.select("date", fc.unlog("prediction").alias("pred"))


@query("ml_random_forest")
def ml_random_forest(spark, root):
    return horizon_predictions(*fitted(spark, root, FULL.forest))


@query("ml_gbt_deep")
def ml_gbt_deep(spark, root):
    return horizon_predictions(*fitted(spark, root, CONFIG.deep))


@query("ml_gbt_shallow")
def ml_gbt_shallow(spark, root):
    return horizon_predictions(*fitted(spark, root, CONFIG.shallow))


@query("ml_score")
def ml_score(spark, root):
    """Staged scoring next to the model's own transform."""
    m, model = fitted(spark, root, CONFIG.shallow)
    ensemble = trees.load_ensemble(trees.node_table(spark, model))
    scored = trees.score_ensembles(model.transform(m.horizon).select(
        "date", "features", F.col("prediction").alias("direct")
    ), {"staged": ensemble})
    return scored.select("date", "direct", "staged")


@query("ml_round_curve")
def ml_round_curve(spark, root):
    """Validation error of both boosted models by round, on the last fold."""
    m = matrix(spark, root)
    cells = [
        trees.Cell(spec.name, CONFIG.n_splits, "log_revenue", spec)
        for spec in (CONFIG.deep, CONFIG.shallow)
    ]
    past = m.train.filter(F.col("fold") < CONFIG.n_splits)
    saved = {c.name: trees.save(trees.fit(past, c.label, c.spec)) for c in cells}
    models = trees.load_ensembles(trees.node_tables(spark, saved))
    return trees.round_curves(m.train, cells, models)


def cv(spark, root):
    m = matrix(spark, root)
    return m, fc.run_cv(m, CONFIG)


@query("ts_oof")
def ts_oof(spark, root):
    m, result = cv(spark, root)
    return fc.complete_oof(m, result, CONFIG).select(
        "date", "fold", "model", "target", "pred", "actual"
    )


@query("ts_cv_run")
def ts_cv_run(spark, root):
    _, result = cv(spark, root)
    used = spark.createDataFrame(
        result.rounds, "fold int, model string, target string, rounds int"
    )
    return scoring.fold_scores(result.oof).join(used, ["fold", "model", "target"])


def base_matrix(spark, root):
    """Stack matrix over the deterministic base forecasts, with actuals."""
    oof = stage(base_oof(spark, root), "base_oof")
    actual = oof.groupBy("date", "target").agg(F.max("actual").alias("actual"))
    rows = scoring.stack_matrix(oof, list(MODELS)).join(actual, ["date", "target"])
    rows = stage(rows, "base_matrix")
    return trees.settle(rows, rows.count()).persist()


def meta_query(name):
    def run(spark, root):
        fits = stack.fit_stack(base_matrix(spark, root), list(MODELS), CONFIG.meta_spec(name))
        return stack.stack_weights(fits, spark).withColumn("weight", F.round("weight", 4))

    return run


STACK_SQL = {
    **BASE_SQL,
    "st": """
        select date, target, max(pred) filter (model = 'lag_1y') as x1,
               max(pred) filter (model = 'monthday_mean') as x2,
               max(pred) filter (model = 'month_mean') as x3, max(actual) as y
        from oof group by 1, 2""",
}

# Ridge on three columns has a closed form: the normal equations by Cramer's rule.
SOLVED = """select target, unnest(['lag_1y', 'monthday_mean', 'month_mean', 'intercept']) as model,
              unnest([w1, w2, w3, my - w1 * m1 - w2 * m2 - w3 * m3]) as weight
       from (select *,
                    (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det as w1,
                    (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det as w2,
                    (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det as w3
             from (select *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) as det
                   from sums))"""
RIDGE_CTES = {
    **STACK_SQL,
    "sums": """
            select target, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(y) as my,
                   count(*) * var_pop(x1) + 1 as a, count(*) * covar_pop(x1, x2) as b,
                   count(*) * covar_pop(x1, x3) as c, count(*) * var_pop(x2) + 1 as d,
                   count(*) * covar_pop(x2, x3) as e, count(*) * var_pop(x3) + 1 as f,
                   count(*) * covar_pop(x1, y) as p, count(*) * covar_pop(x2, y) as q,
                   count(*) * covar_pop(x3, y) as r
            from st group by 1""",
    "weights": SOLVED,
}
RIDGE_SQL = with_ctes(
    "select 'ridge' as meta_learner, target, model, round(weight, 4) as weight from weights", RIDGE_CTES
)


def descent_sql(name: str, sweeps: int = 3000) -> str:
    """Coordinate descent on the covariances of three columns, one recursion step a sweep."""
    spec = stack.META[name]
    l1, l2 = spec.alpha * spec.l1_share, spec.alpha * (1 - spec.l1_share)
    soft = lambda pull, own: f"(sign({pull}) * greatest(abs({pull}) - {l1!r}, 0) / ({own} + {l2!r}))"
    return with_ctes(
        f"""select '{name}' as meta_learner, target, unnest(['lag_1y', 'monthday_mean', 'month_mean', 'intercept']) as model,
                   unnest([round(w1, 4), round(w2, 4), round(w3, 4),
                           round(my - w1 * m1 - w2 * m2 - w3 * m3, 4)]) as weight
            from swept join covs using (target) where step = {sweeps}""",
        {
            **STACK_SQL,
            "covs": """
                select target, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(y) as my,
                       var_pop(x1) as a, covar_pop(x1, x2) as b, covar_pop(x1, x3) as c, var_pop(x2) as d,
                       covar_pop(x2, x3) as e, var_pop(x3) as f, covar_pop(x1, y) as p, covar_pop(x2, y) as q,
                       covar_pop(x3, y) as r from st group by 1""",
            "swept": f"""
                select target, 0 as step, 0::double as w1, 0::double as w2, 0::double as w3 from covs
                union all
                select target, step + 1, v1, v2, {soft("(r - c * v1 - e * v2)", "f")}
                from (select *, {soft("(q - b * v1 - e * w3)", "d")} as v2
                      from (select s.*, k.* exclude (target), {soft("(p - b * w2 - c * w3)", "a")} as v1
                            from swept s join covs k using (target) where step < {sweeps}))""",
        },
    ).replace("with ", "with recursive ", 1)


META_SQL = {"ridge": RIDGE_SQL, "lasso": descent_sql("lasso"), "elasticnet": descent_sql("elasticnet")}

for _name in stack.META:
    query(f"meta_{_name}", META_SQL.get(_name))(meta_query(_name))


@query("stack_weights")
def stack_weights(spark, root):
    """Weights of every linear meta-learner side by side."""
    specs = [CONFIG.meta_spec(name) for name in ("huber", "ridge", "lasso", "elasticnet", "bayesian_ridge")]
    out = None
    for fits in stack.fit_stacks(base_matrix(spark, root), list(MODELS), specs):
        part = stack.stack_weights(fits, spark)
        out = part if out is None else out.unionByName(part)
    return out


@query("stack_forecast")
def stack_forecast(spark, root):
    """Ridge stack of the base forecasts, constrained and formatted."""
    rows = base_matrix(spark, root)
    fits = stack.fit_stack(rows, list(MODELS), CONFIG.meta_spec("ridge"))
    wide = stack.constrain(stack.to_wide(stack.predict_stack(rows.drop("actual"), fits)))
    return stack.format_forecast(wide)


def base_ahead(spark, root):
    """Stack matrix of the base forecasts for the dates to come; no actuals."""
    sales, ahead = split(spark, root)
    rows = attach_stats(with_calendar(ahead), seasonal.monthday_means(sales), ["month", "day"])
    rows = attach_stats(rows, seasonal.monthday_means_recent(sales), ["month", "day"])
    rows = attach_stats(rows, seasonal.month_means(sales), ["month"])
    rows = lags.fill_horizon_lag(lags.attach_lag(rows, sales))
    # a day that no past year has, or a lag that both years lack, falls back on its month
    rows = rows.withColumns(
        {
            c: F.coalesce(c, f"hist_month_{t}_mean")
            for t in ("revenue", "cogs")
            for c in (f"hist_monthday_{t}_mean", f"lag_1y_{t}")
        }
    )
    return stage(
        rows.select(
            "date",
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(t).alias("target"), *[F.col(MODELS[m][i]).alias(m) for m in MODELS])
                        for i, t in enumerate(("revenue", "cogs"))
                    ]
                )
            ),
        ),
        "base_ahead",
    )


AHEAD_SQL = {
    **RIDGE_CTES,
    "hwide": """
        select date, month, coalesce(m.hist_monthday_revenue_mean, o.hist_month_revenue_mean) as md_revenue,
               coalesce(m.hist_monthday_cogs_mean, o.hist_month_cogs_mean) as md_cogs,
               o.hist_month_revenue_mean as mo_revenue, o.hist_month_cogs_mean as mo_cogs,
               coalesce(case when lag_1y_revenue is null then hist_monthday_revenue_mean_2y else lag_1y_revenue end,
                        o.hist_month_revenue_mean) as lag_revenue,
               coalesce(case when lag_1y_revenue is null then hist_monthday_cogs_mean_2y else lag_1y_cogs end,
                        o.hist_month_cogs_mean) as lag_cogs
        from hcalendar left join lags using (date) left join md m using (month, day)
             left join md2 using (month, day) left join mo o using (month)""",
    "stacked_ahead": """
        select date, """
    + ", ".join(
        f"""(select sum(weight * case model when 'lag_1y' then lag_{t} when 'monthday_mean' then md_{t}
                                            when 'month_mean' then mo_{t} else 1 end)
             from weights where target = '{t}') as {t}"""
        for t in ("revenue", "cogs")
    )
    + " from hwide",
}


@query(
    "stack_horizon",
    with_ctes(
        """select date, round(greatest(revenue, 0), 2) as revenue,
                  round(least(greatest(cogs, 0), 0.995::double * greatest(revenue, 0)), 2) as cogs
           from stacked_ahead""",
        AHEAD_SQL,
    ),
)
def stack_horizon(spark, root):
    """Ridge stack fitted on the history, for the dates to come."""
    fits = stack.fit_stack(base_matrix(spark, root), list(MODELS), CONFIG.meta_spec("ridge"))
    wide = stack.constrain(stack.to_wide(stack.predict_stack(base_ahead(spark, root), fits)))
    return wide.select("date", F.round("revenue", 2).alias("revenue"), F.round("cogs", 2).alias("cogs"))


@query("stack_residual_horizon")
def stack_residual_horizon(spark, root):
    """The stack of the dates to come, corrected by the residual layer over their features."""
    rows, m = base_matrix(spark, root), matrix(spark, root)
    fits = stack.fit_stack(rows, list(MODELS), CONFIG.meta_spec("ridge"))
    stacked = stage(stack.predict_stack(rows, fits), "stacked")
    residual = stack.fit_residual(stacked, m.train.select("date", *m.columns), m.columns)
    ahead = stack.predict_stack(base_ahead(spark, root), fits)
    moved = stack.predict_residual(ahead, m.horizon.select("date", *m.columns), residual)
    return stack.constrain(stack.to_wide(moved)).select("date", "revenue", "cogs")


@query("stack_residual")
def stack_residual(spark, root):
    """Ridge stack corrected by the linear residual layer over the features."""
    rows = base_matrix(spark, root)
    m = matrix(spark, root)
    fits = stack.fit_stack(rows, list(MODELS), CONFIG.meta_spec("ridge"))
    stacked = stage(stack.predict_stack(rows, fits), "stacked")
    x = m.train.select("date", *m.columns)
    residual = stack.fit_residual(stacked, x, m.columns)
    return stack.predict_residual(stacked, x, residual)


def board(spark, root):
    specs = [CONFIG.meta_spec(name) for name in stack.META]
    return stack.compare_stackers(base_matrix(spark, root), list(MODELS), specs=specs)


@query("stack_compare")
def stack_compare(spark, root):
    return board(spark, root).drop("ordinal")


@query("stack_best")
def stack_best(spark, root):
    return stack.best_stacker(board(spark, root))


@query("forecast_full")
def forecast_full(spark, root):
    m = matrix(spark, root)
    return fc.run_forecast(m, CONFIG).forecast


@query(
    "snk_forecast",
    with_ctes(
        """select strftime(date, '%Y-%m-%d') as Date, round_even(r, 2) as Revenue,
                  round_even(least(greatest(c, 0), 0.995::double * greatest(r, 0)), 2) as COGS,
                  variant
           from (select date, 'lag_1y' as variant, lag_1y_revenue as r, lag_1y_cogs as c from wide
                 union all
                 select date, 'monthday_mean', hist_monthday_revenue_mean, hist_monthday_cogs_mean
                 from wide
                 union all
                 select date, 'month_mean', hist_month_revenue_mean, hist_month_cogs_mean from wide)""",
        BASE_SQL,
    ),
)
def snk_forecast(spark, root):
    """The base forecasts as variants: constrained, formatted, written and read back."""
    wide = base_wide(spark, root)
    out = None
    for name, (revenue, cogs) in MODELS.items():
        rows = wide.select("date", F.col(revenue).alias("revenue"), F.col(cogs).alias("cogs"))
        part = stack.format_forecast(stack.constrain(rows)).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    path = stage_path(spark, "forecast")
    sinks.write_forecast(out, path)
    schema = "Date string, Revenue double, COGS double, variant string"
    return spark.read.option("header", True).schema(schema).csv(path)


@query("imp_rf")
def imp_rf(spark, root):
    m, model = fitted(spark, root, FULL_IMPORTANCE.forest)
    return trees.impurity_importance(spark, model, m.columns)


@query("imp_gain_total")
def imp_gain_total(spark, root):
    m, model = fitted(spark, root, IMPORTANCE.deep)
    return trees.gain_importance(spark, trees.node_table(spark, model), m.columns, "sum")


@query("imp_gain_mean")
def imp_gain_mean(spark, root):
    m, model = fitted(spark, root, IMPORTANCE.shallow)
    return trees.gain_importance(spark, trees.node_table(spark, model), m.columns, "avg")


@query("imp_target_average")
def imp_target_average(spark, root):
    """Forest importances of both targets averaged per feature."""
    m = matrix(spark, root)
    out = None
    for target in ("revenue", "cogs"):
        model = trees.fit(m.train, f"log_{target}", FULL_IMPORTANCE.forest)
        part = trees.impurity_importance(spark, model, m.columns).select(
            F.lit("rf").alias("source"), "feature", F.lit(target).alias("target"), "score"
        )
        out = part if out is None else out.unionByName(part)
    return ranking.average_targets(out)


def attributed(spark, root):
    m, model = fitted(spark, root, IMPORTANCE.deep)
    ensemble = trees.load_ensemble(trees.node_table(spark, model))
    rows = model.transform(m.train).select("date", "features", "prediction")
    return m, attribution.attribute(rows, ensemble, len(m.columns))


@query("imp_attribution")
def imp_attribution(spark, root):
    """Attributions of every row next to the prediction they add up to."""
    _, rows = attributed(spark, root)
    total = F.aggregate("phi", F.col("base"), lambda acc, x: acc + x)
    return rows.select("date", "prediction", "base", total.alias("explained"), "phi")


@query("imp_mean_abs_attr")
def imp_mean_abs_attr(spark, root):
    m, rows = attributed(spark, root)
    return attribution.mean_abs(rows, m.columns)


@query("imp_combined")
def imp_combined(spark, root):
    m = matrix(spark, root)
    return imp.run_importance(m.train, m.columns, IMPORTANCE)
