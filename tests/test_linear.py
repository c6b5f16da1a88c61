"""Penalised meta-learners against closed forms and optimality conditions."""

import numpy as np
import pytest

from dailycast.operators import linear, stack


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) @ np.array([[3.0, 1.0, 0.0], [0.0, 2.0, 0.5], [0.0, 0.0, 1.5]]) + 5
    y = x @ np.array([2.0, -1.0, 0.5]) + 7 + rng.normal(size=400)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, ["a", "b", "c", "y"]).coalesce(1).cache()
    return df, x, y


def fit(data, spec):
    f = linear.fit_meta(data[0], ["a", "b", "c"], "y", spec)
    return np.array(f.weights), f.intercept


def test_ridge_closed_form(data):
    _, x, y = data
    w, b = fit(data, linear.META["ridge"])
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert w == pytest.approx(want, rel=1e-7)
    assert b == pytest.approx(y.mean() - x.mean(0) @ want, rel=1e-7)


@pytest.mark.parametrize("name", ["lasso", "elasticnet"])
def test_l1_optimality(data, name):
    """The gradient of the loss balances the penalty on every weight."""
    _, x, y = data
    spec = linear.META[name]
    w, b = fit(data, spec)
    g = x.T @ (y - x @ w - b) / len(y) - spec.alpha * (1 - spec.l1_share) * w
    l1 = spec.alpha * spec.l1_share
    for gj, wj in zip(g, w):
        if abs(wj) > 1e-9:
            assert gj == pytest.approx(l1 * np.sign(wj), abs=1e-5)
        else:
            assert abs(gj) <= l1 + 1e-5


@pytest.mark.parametrize("target", ["revenue", "cogs"])
def test_residual_penalty_on_standardised_features(data, target):
    df, x, y = data
    spec = stack.RESIDUAL[target]
    w, b = fit(data, spec)
    sd = x.std(0)
    z, wz = (x - x.mean(0)) / sd, w * sd
    g = z.T @ (y - x @ w - b) / len(y) - spec.alpha * (1 - spec.l1_share) * wz
    assert g == pytest.approx(spec.alpha * spec.l1_share * np.sign(wz), abs=1e-5)


def test_bayesian_ridge_is_a_fixed_point(data):
    _, x, y = data
    w, b = fit(data, linear.META["bayesian_ridge"])
    xc, yc = x - x.mean(0), y - y.mean()
    noise, slope = 1.0, 1.0
    for _ in range(200):
        want = np.linalg.solve(xc.T @ xc + slope / noise * np.eye(3), xc.T @ yc)
        eig = np.linalg.eigvalsh(xc.T @ xc)
        used = np.sum(noise * eig / (slope + noise * eig))
        slope = used / (want @ want)
        noise = (len(y) - used) / np.sum((yc - xc @ want) ** 2)
    assert w == pytest.approx(want, rel=1e-5)
    assert b == pytest.approx(y.mean() - x.mean(0) @ want, rel=1e-5)


def test_huber_resists_outliers(spark, data):
    _, x, y = data
    bad = y.copy()
    bad[:20] += 500
    rows = [(*map(float, r), float(v)) for r, v in zip(x, bad)]
    df = spark.createDataFrame(rows, ["a", "b", "c", "y"]).coalesce(1)
    f = linear.fit_meta(df, ["a", "b", "c"], "y", linear.META["huber"])
    assert np.array(f.weights) == pytest.approx([2.0, -1.0, 0.5], abs=0.2)


def test_moments_merge_to_those_of_all_rows(spark, data):
    df, x, y = data
    rows = df.selectExpr("*", "if(a > 5, 'up', 'down') as side").repartition(7)
    got = linear.moments_by(rows.union(rows.limit(1).selectExpr("null as a", "b", "c", "y", "side")), ["a", "b", "c"], "y", "side")
    for side, mine in (("up", x[:, 0] > 5), ("down", x[:, 0] <= 5)):
        every = np.column_stack([x, y])[mine]
        assert got[side].n == mine.sum() and got[side].mean == pytest.approx(every.mean(0))
        assert got[side].scatter == pytest.approx(np.cov(every.T, ddof=0) * mine.sum(), rel=1e-9)


def test_one_scan_serves_all_learners_of_moments(spark, data, monkeypatch):
    rows = data[0].selectExpr("a", "b", "c", "y as actual", "if(a > 5, 'revenue', 'cogs') as target")
    calls = []
    real = linear.moments_by
    monkeypatch.setattr(stack, "moments_by", lambda *a: (calls.append(a), real(*a))[1])
    specs = [linear.META[n] for n in ("ridge", "lasso", "elasticnet", "bayesian_ridge")]
    fits = stack.fit_stacks(rows, ["a", "b", "c"], specs)
    assert len(calls) == 1 and len(fits) == 4 and all(set(f) == {"revenue", "cogs"} for f in fits)
    for spec, both in zip(specs, fits):
        alone = linear.fit_meta(stack.of_target(rows, "cogs"), ["a", "b", "c"], "actual", spec)
        assert both["cogs"].weights == pytest.approx(alone.weights, rel=1e-9)


def test_constant_features_get_no_weight(spark):
    rows = spark.createDataFrame([(float(i), 1.0, 2.0 * i) for i in range(9)], ["a", "b", "y"])
    f = linear.fit_meta(rows, ["a", "b"], "y", stack.RESIDUAL["cogs"])
    assert f.weights[1] == 0.0 and f.weights[0] == pytest.approx(2.0, abs=0.01)


def test_column_predicts_like_the_weights(data):
    df, x, _ = data
    f = linear.fit_meta(df, ["a", "b", "c"], "y", linear.META["ridge"])
    got = np.array([r[0] for r in f.predict(df, "p").select("p").collect()])
    assert got == pytest.approx(x @ np.array(f.weights) + f.intercept)


def test_unknown_name():
    with pytest.raises(ValueError):
        linear.choose("nope")
