"""Meta-learners on the stack matrix.

Ridge, lasso, elastic net and Bayesian ridge need no more than the second moments of the
rows, so one job collects those for all targets and serves all four; what is left is a
k x k problem. Huber and boosted learners are Spark ML fits. Penalties follow the usual
definition, mean squared error over two plus ``l1 * |w| + l2 / 2 * |w|^2``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailycast.operators.trees import assemble


@dataclass(frozen=True)
class MetaSpec:
    name: str
    kind: str  # "huber", "penalty", "bayes" or "boosted"
    alpha: float = 0.0
    l1_share: float = 0.0
    sum_loss: bool = False  # penalty stated against the summed, not the mean, loss
    scaled: bool = False  # standardise the features first
    epsilon: float = 1.35
    rounds: int = 100
    depth: int = 3
    step: float = 0.1
    seed: int = 42


# The meta-learners one can choose from, in comparison order.
META = {
    "huber": MetaSpec("huber", "huber", alpha=1e-4),
    "ridge": MetaSpec("ridge", "penalty", alpha=1.0, sum_loss=True),
    "lasso": MetaSpec("lasso", "penalty", alpha=1.0, l1_share=1.0),
    "elasticnet": MetaSpec("elasticnet", "penalty", alpha=0.1, l1_share=0.5),
    "bayesian_ridge": MetaSpec("bayesian_ridge", "bayes"),
    "gbm": MetaSpec("gbm", "boosted", rounds=100, depth=3),
}


@dataclass(frozen=True)
class MetaFit:
    """A fitted meta-learner: linear weights, or a boosted model and its importances."""

    spec: MetaSpec
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float | None
    model: object = None

    def column(self) -> Column:
        """A linear prediction as a plain expression, inside generated code."""
        total = F.lit(self.intercept)
        for w, c in zip(self.weights, self.features):
            total = total + F.lit(w) * F.col(c)
        return total

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(out, self.column())
        scored = self.model.transform(assemble(df, self.features, "_stack"))
        return scored.withColumnRenamed("_meta", out).drop("_stack")


def choose(name: str, **changes) -> MetaSpec:
    if name not in META:
        raise ValueError(f"unknown meta-learner {name!r}; choose from {list(META)}")
    base = META[name]
    return MetaSpec(**{**base.__dict__, **changes})


def fit_meta(df: DataFrame, features: Sequence[str], label: str, spec: MetaSpec) -> MetaFit:
    """One learner on one table."""
    if from_moments(spec):
        (m,) = moments_by(df.withColumn("_all", F.lit("all")), features, label, "_all").values()
        return solve(m, features, spec)
    rows = assemble(df, features, "_stack")
    if spec.kind == "boosted":
        model = GBTRegressor(
            featuresCol="_stack", labelCol=label, predictionCol="_meta", maxIter=spec.rounds,
            maxDepth=spec.depth, stepSize=spec.step, seed=spec.seed,
        ).fit(rows)
        weights = tuple(float(w) for w in model.featureImportances.toArray())
        return MetaFit(spec, tuple(features), weights, None, model)
    model = LinearRegression(
        featuresCol="_stack", labelCol=label, predictionCol="_meta", loss="huber", epsilon=spec.epsilon,
        regParam=spec.alpha / df.filter(F.col(label).isNotNull()).count(), standardization=False, maxIter=2000,
    ).fit(rows)
    weights = tuple(float(w) for w in model.coefficients)
    return MetaFit(spec, tuple(features), weights, float(model.intercept))


def from_moments(spec: MetaSpec) -> bool:
    return spec.kind in ("penalty", "bayes")


@dataclass(frozen=True)
class Moments:
    """Count, means and centred sums of products of the features and, last, the label."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0)
        away = rows - mean
        return Moments(len(rows), mean, away.T @ away)

    def __add__(self, other: Moments) -> Moments:
        n, away = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(away, away) * (self.n * other.n / n)
        return Moments(n, self.mean + away * (other.n / n), scatter)

    def row(self, group: str) -> dict:
        return {"group": group, "n": self.n, "mean": self.mean.tolist(), "scatter": self.scatter.ravel().tolist()}

    @staticmethod
    def read(row) -> Moments:
        mean = np.array(row["mean"])
        return Moments(int(row["n"]), mean, np.array(row["scatter"]).reshape(len(mean), len(mean)))


_MOMENTS = "group string, n long, mean array<double>, scatter array<double>"


def moments_by(df: DataFrame, features: Sequence[str], label: str, group: str) -> dict[str, Moments]:
    """Moments of the rows of every group, from one scan; groups are few, such as the targets.

    A task returns one row of k x k numbers for each group; about sqrt(tasks) slots merge those on
    executors, in the order of the tasks, and the driver merges the slots. Rows with a NULL
    among the columns are left out.
    """
    columns = [*features, label]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Moments] = {}
        for b in batches:
            for key, rows in b.dropna().groupby("_group"):
                m = Moments.of(rows[columns].to_numpy(np.float64))
                found[key] = found[key] + m if key in found else m
        yield pd.DataFrame([m.row(k) for k, m in found.items()], columns=["group", "n", "mean", "scatter"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, Moments] = {}
        for r in rows.sort_values("part").to_dict("records"):
            m = Moments.read(r)
            found[r["group"]] = found[r["group"]] + m if r["group"] in found else m
        return pd.DataFrame([m.row(k) for k, m in found.items()])

    rows = df.select(F.col(group).cast("string").alias("_group"), *[F.col(c).cast("double").alias(c) for c in columns])
    slots = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    parts = rows.mapInPandas(partial, _MOMENTS).withColumn("part", F.spark_partition_id())
    merged = parts.groupBy("group", (F.col("part") % slots).alias("slot")).applyInPandas(merge, _MOMENTS)
    out: dict[str, Moments] = {}
    for r in sorted(merged.collect(), key=lambda r: (r["group"], r["n"], r["mean"])):
        m = Moments.read(r)
        out[r["group"]] = out[r["group"]] + m if r["group"] in out else m
    return out


def solve(m: Moments, features: Sequence[str], spec: MetaSpec) -> MetaFit:
    """The learner that the moments determine."""
    k = len(features)
    xx, xy, yy = m.scatter[:k, :k], m.scatter[:k, k], m.scatter[k, k]
    weights = _bayes(m.n, xx, xy, yy) if spec.kind == "bayes" else _descend(m.n, xx, xy, spec)
    intercept = float(m.mean[k] - m.mean[:k] @ weights)
    return MetaFit(spec, tuple(features), tuple(float(w) for w in weights), intercept)


def _descend(n: int, xx: np.ndarray, xy: np.ndarray, spec: MetaSpec, sweeps: int = 100_000, tol: float = 1e-12) -> np.ndarray:
    """Coordinate descent on covariances; a pass over weights costs k x k, however many rows there are."""
    c, q = xx / n, xy / n
    scale = np.sqrt(np.diag(c)) if spec.scaled else np.ones(len(q))
    scale = np.where(scale > 0, scale, 1.0)
    c, q = c / np.outer(scale, scale), q / scale
    l1 = spec.alpha * spec.l1_share
    l2 = spec.alpha * (1.0 - spec.l1_share) / (n if spec.sum_loss else 1)
    if not l1:
        return np.linalg.lstsq(c + l2 * np.eye(len(q)), q, rcond=None)[0] / scale
    w = np.zeros(len(q))
    for _ in range(sweeps):
        most = 0.0
        for j in np.flatnonzero(np.diag(c) > 0):
            pull = q[j] - c[j] @ w + c[j, j] * w[j]
            new = math.copysign(max(abs(pull) - l1, 0.0), pull) / (c[j, j] + l2)
            most = max(most, abs(new - w[j]) * math.sqrt(c[j, j]))
            w[j] = new
        if most <= tol * max(1.0, math.sqrt(abs(q @ w))):
            break
    return w / scale


def _bayes(
    n: int, xx: np.ndarray, xy: np.ndarray, yy: float, max_iter: int = 300, tol: float = 1e-3, prior: float = 1e-6
) -> np.ndarray:
    """Evidence maximisation (MacKay 1992): a k x k problem per step."""
    eig, basis = np.linalg.eigh(xx)
    eig, target = np.maximum(eig, 0.0), basis.T @ xy
    noise, slope = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    previous = None
    for _ in range(max_iter):
        weights = basis @ (target / (eig + slope / noise))
        sse = yy - 2 * weights @ xy + weights @ xx @ weights
        used = float(np.sum(noise * eig / (slope + noise * eig)))
        slope = (used + 2 * prior) / (float(weights @ weights) + 2 * prior)
        noise = (n - used + 2 * prior) / (max(sse, 0.0) + 2 * prior)
        if previous is not None and np.abs(weights - previous).sum() < tol:
            break
        previous = weights
    return basis @ (target / (eig + slope / noise))


def weight_rows(fit: MetaFit, target: str) -> list[tuple[str, str, str, float]]:
    """``meta_learner, target, model, weight`` rows, the intercept among them."""
    rows = [(fit.spec.name, target, f, w) for f, w in zip(fit.features, fit.weights)]
    if fit.intercept is not None:
        rows.append((fit.spec.name, target, "intercept", fit.intercept))
    return rows
