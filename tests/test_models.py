"""Trees, early stopping, attribution, stacking and importance on planted signals."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dailycast.operators import attribution, ranking, scoring, stack, trees
from dailycast.plans import forecast as fc
from dailycast.plans import importance as imp

START = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def matrix(spark):
    """A step and a weekly pattern drive the targets; ``noise`` drives nothing."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(420):
        d = START + dt.timedelta(i)
        step, week = float(i % 50 >= 25), float(i % 7)
        base = 1000 + 800 * step + 90 * week + rng.normal() * 5
        rows.append((d, float(base), float(base * 0.6), step, week, 0.0))
    schema = "date date, revenue double, cogs double, step double, week double, unused double"
    train = spark.createDataFrame(rows[:400], schema)
    ahead = spark.createDataFrame(rows[400:], schema).select("date", "week", "step")
    return fc.build_matrix(train, ahead, ["step", "week", "unused"])


@pytest.fixture(scope="module")
def cv(matrix):
    return fc.run_cv(matrix, fc.small_config(rounds=8, trees_per_forest=5))


def dense(rows):
    return np.array([r["features"].toArray() for r in rows])


@pytest.mark.parametrize("spec", [fc.small_config().forest, fc.small_config().shallow])
def test_node_table_scores_like_the_model(spark, matrix, spec):
    model = trees.fit(matrix.train, "log_revenue", spec, 6)
    ensemble = trees.load_ensemble(trees.node_table(spark, model))
    rows = model.transform(matrix.train).select("features", "prediction").collect()
    assert ensemble.predict(dense(rows)) == pytest.approx([r["prediction"] for r in rows])


def test_shorter_fit_is_a_prefix(spark, matrix):
    spec = fc.small_config().deep
    long = trees.load_ensemble(trees.node_table(spark, trees.fit(matrix.train, "log_revenue", spec, 6)))
    short = trees.load_ensemble(trees.node_table(spark, trees.fit(matrix.train, "log_revenue", spec, 3)))
    x = dense(matrix.train.select("features").collect())
    assert long.prefix(3).predict(x) == pytest.approx(short.predict(x), abs=0)


def test_round_curve_by_hand(spark, matrix):
    model = trees.fit(matrix.train, "log_revenue", fc.small_config().shallow, 4)
    e = trees.load_ensemble(trees.node_table(spark, model))
    rows = matrix.train.select("features", "log_revenue").collect()
    y = np.array([r["log_revenue"] for r in rows])
    cell = trees.Cell("a", 0, "log_revenue", fc.small_config().shallow)
    everything = matrix.train.withColumn("fold", F.lit(0))
    curve = trees.round_curves(everything, [cell], {"a": e}).collect()
    got = {r["round"]: r["mape"] for r in curve}
    for k in range(1, 5):
        want = np.mean(np.abs(y - e.prefix(k).predict(dense(rows))) / (np.abs(y) + 1e-9))
        assert got[k] == pytest.approx(want)


def brute_shapley(ensemble, x, n_features):
    """Every coalition of features, by walking the trees."""

    def value(known):
        def walk(t, node):
            if ensemble.left[t][node] < 0:
                return ensemble.value[t][node]
            f = ensemble.feature[t][node]
            a, b = ensemble.left[t][node], ensemble.right[t][node]
            if f in known:
                return walk(t, a if x[f] <= ensemble.threshold[t][node] else b)
            share = ensemble.rows[t][a] / ensemble.rows[t][node]
            return share * walk(t, a) + (1 - share) * walk(t, b)

        return sum(w * walk(t, 0) for t, w in enumerate(ensemble.weights))

    phi = np.zeros(n_features)
    for i in range(n_features):
        rest = [j for j in range(n_features) if j != i]
        for size in range(n_features):
            w = math.factorial(size) * math.factorial(n_features - 1 - size) / math.factorial(n_features)
            for s in itertools.combinations(rest, size):
                phi[i] += w * (value({*s, i}) - value(set(s)))
    return phi


@pytest.mark.parametrize("spec", [fc.small_config().forest, fc.small_config().deep])
def test_attribution_against_every_coalition(spark, matrix, spec):
    model = trees.fit(matrix.train, "log_revenue", spec, 4)
    e = trees.load_ensemble(trees.node_table(spark, model))
    rows = model.transform(matrix.train).select("date", "features", "prediction")
    out = attribution.attribute(rows, e, 3).join(rows.select("date", "features"), "date").collect()
    for r in out:
        assert sum(r["phi"]) + r["base"] == pytest.approx(r["prediction"])
    for r in out[:5]:
        want = brute_shapley(e, r["features"].toArray(), 3)
        assert np.array(r["phi"]) == pytest.approx(want, abs=1e-9)
        assert r["phi"][2] == 0.0


@pytest.mark.parametrize("width", [1, 2, 5, 12])
def test_leaf_attribution_against_coalition_sums(width):
    """Depth 12 costs 6 Gauss nodes; a table over patterns would have 4096 entries a slot."""
    rng = np.random.default_rng(width)
    share, inside = rng.uniform(0.05, 1, width), rng.integers(0, 2, (4, width)).astype(float)
    got = attribution.leaf_shapley([inside[:, [j]] for j in range(width)], share[None, :], np.array([3.0]))
    for r in range(4):
        for i in range(width):
            coef = np.array([1.0])
            for j in range(width):
                if j != i:
                    coef = np.convolve(coef, [share[j], inside[r, j]])
            weight = [math.factorial(s) * math.factorial(width - 1 - s) / math.factorial(width) for s in range(width)]
            want = 3.0 * (inside[r, i] - share[i]) * float(coef @ weight)
            assert got[i][r, 0] == pytest.approx(want, rel=1e-12, abs=1e-15)


def test_attribution_adds_up_at_full_depth_and_length():
    """500 trees of depth 6 on 30 features, the size of a whole importance run."""
    rng = np.random.default_rng(3)
    model = trees.Ensemble([])
    for _ in range(500):
        n, depth = 127, 6
        inner = np.arange(n) < 2**depth - 1
        rows = np.where(inner, 0, rng.integers(1, 30, n)).astype(float)
        for k in range(2**depth - 2, -1, -1):
            rows[k] = rows[2 * k + 1] + rows[2 * k + 2]
        model.weights.append(0.03)
        model.feature.append(rng.integers(0, 30, n))
        model.threshold.append(rng.normal(size=n))
        model.left.append(np.where(inner, 2 * np.arange(n) + 1, -1))
        model.right.append(np.where(inner, 2 * np.arange(n) + 2, -1))
        model.value.append(rng.normal(size=n))
        model.rows.append(rows)
    x = rng.normal(size=(40, 30))
    base, groups = attribution.leaf_groups(model)
    phi = attribution.attribute_block(x, groups, 30)
    assert phi.sum(axis=1) + base == pytest.approx(model.predict(x), abs=1e-9)


def test_mean_abs_exchanges_one_row_a_task(spark):
    rows = spark.createDataFrame([([1.0, -2.0],), ([-3.0, 0.0],)], "phi array<double>")
    got = attribution.mean_abs(rows, ["a", "b"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert {tuple(r) for r in got.collect()} == {("a", 2.0), ("b", 1.0)}


def test_cv_predicts_every_validated_row_once(matrix, cv):
    oof = fc.complete_oof(matrix, cv, fc.ForecastConfig())
    per_row = oof.groupBy("date", "model", "target").count()
    assert per_row.filter("count <> 1").isEmpty()
    assert per_row.count() == 400 * 3 * 2
    head = oof.filter("fold = 0")
    assert head.filter("pred <> 0").isEmpty() and head.select("date").distinct().count() == 400 - 5 * 66
    assert cv.horizon.count() == 20 * 3 * 2 * 5
    none = fc.complete_oof(matrix, cv, fc.ForecastConfig(oof_fill=None))
    assert none.filter("fold = 0").isEmpty()


def test_models_beat_the_mean(cv):
    scores = scoring.fold_scores(cv.oof).filter("fold = 5").collect()
    assert len(scores) == 6 and all(r["r2"] > 0.5 for r in scores)


def test_full_run(spark, matrix):
    config = fc.small_config(rounds=6, trees_per_forest=5)
    run = fc.run_forecast(matrix, config)
    rows = run.forecast.collect()
    assert {r["variant"] for r in rows} == {"stack", "stack_residual"} and len(rows) == 40
    assert all(0 <= r["COGS"] <= 0.995 * r["Revenue"] + 0.01 for r in rows)
    scores = {}
    for r in run.variant_scores.collect():
        scores[r["variant"]] = scores.get(r["variant"], 0) + r["mape"]
    assert run.best.first()["variant"] == min(scores, key=lambda v: (scores[v], v))
    assert run.fold_scores.count() == 30 and run.oof_scores.count() == 6
    assert run.bounds.count() == 5


def test_pick_variant_prefers_the_earlier_on_ties(spark):
    df = spark.createDataFrame(
        [("b", "x", 0.1), ("a", "x", 0.1), ("c", "x", 0.3)], "variant string, target string, mape double"
    )
    assert stack.pick_variant(df, ["b", "a", "c"]).first()["variant"] == "b"
    assert stack.pick_variant(df, ["a", "b", "c"]).first()["variant"] == "a"


def test_importance_ranks_the_signal(matrix):
    got = imp.run_importance(matrix.train, matrix.columns, imp.small_config(6, 5)).collect()
    by = {r["feature"]: r for r in got}
    assert [r["feature"] for r in got] == ["step", "week", "unused"]
    assert by["unused"]["overall_mean"] == 0.0
    for s in (*ranking.NATIVE, *ranking.ATTRIBUTED):
        assert sum(r[s] for r in got) == pytest.approx(1.0)


def test_normalize_leaves_zero_totals_alone(spark):
    df = spark.createDataFrame([("z", "a", 0.0), ("p", "a", 3.0), ("p", "b", 1.0)], "source string, feature string, score double")
    got = {(r["source"], r["feature"]): r["score"] for r in ranking.normalize(df).collect()}
    assert got == {("z", "a"): 0.0, ("p", "a"): 0.75, ("p", "b"): 0.25}


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    a = sorted(r[0] for r in ranking.sample_rows(df, ["id"], 50).collect())
    b = sorted(r[0] for r in ranking.sample_rows(df.repartition(7), ["id"], 50).collect())
    assert a == b and len(set(a)) == 50
    assert ranking.sample_rows(df.limit(5), ["id"], 50).count() == 5
    assert a != sorted(r[0] for r in ranking.sample_rows(df, ["id"], 50, seed=7).collect())


def test_residual_layer_reaches_the_horizon(spark):
    """Every date to come has a forecast: whole, non-negative and below its margin cap."""
    from dailycast.catalog import QUERIES
    from dailycast.catalog.facts import split

    root = "/root/testdata/sf0.001"
    rows = QUERIES["stack_residual_horizon"](spark, root).collect()
    dates = {r["date"] for r in split(spark, root)[1].collect()}
    assert {r["date"] for r in rows} == dates and len(rows) == len(dates)
    assert all(0 <= r["cogs"] <= 0.995 * r["revenue"] for r in rows)
    assert any(r["revenue"] > 0 for r in rows)
