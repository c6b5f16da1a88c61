"""Cross-validated base models, stacking, residual layer and the final forecast."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.functions.numeric import log_target, unlog
from dailycast.operators import boosting, folds, impute, linear, scoring, stack, trees
from dailycast.sources.ledger import Ledger, fingerprint
from dailycast.sources.staging import run_together, stage
from dailycast.sources.tables import align_columns

TARGETS = scoring.TARGETS


@dataclass(frozen=True)
class ForecastConfig:
    """Settings of a run; the defaults are the full-size ones."""

    n_splits: int = folds.N_SPLITS
    forest: trees.TreeSpec = trees.FOREST
    deep: trees.TreeSpec = trees.DEEP
    shallow: trees.TreeSpec = trees.SHALLOW
    meta: str = "gbm"
    meta_rounds: int = 100
    oof_fill: float | None = 0.0
    workers: int = 8

    @property
    def specs(self) -> tuple[trees.TreeSpec, ...]:
        return (self.forest, self.deep, self.shallow)

    def meta_spec(self, name: str | None = None):
        return linear.choose(name or self.meta, rounds=self.meta_rounds)


def small_config(rounds: int = 8, trees_per_forest: int = 20, n_splits: int = 5) -> ForecastConfig:
    """The same steps with few trees and a large step, for trial runs."""
    return ForecastConfig(
        n_splits=n_splits,
        forest=replace(trees.FOREST, max_rounds=trees_per_forest, depth=5),
        deep=replace(trees.DEEP, max_rounds=rounds, step=0.3, patience=3, depth=4),
        shallow=replace(
            trees.SHALLOW, max_rounds=rounds, step=0.3, patience=3, depth=3
        ),
        meta_rounds=20,
    )


@dataclass(frozen=True)
class Matrix:
    """Imputed rows ready for fitting, and for the horizon."""

    train: DataFrame  # keys…, date, revenue, cogs, log_*, fold, features, columns…
    horizon: DataFrame
    columns: list[str]
    rows: int
    keys: tuple[str, ...] = ()


def build_matrix(
    train: DataFrame,
    horizon: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    n_splits: int = folds.N_SPLITS,
) -> Matrix:
    """Fill, assign folds, take logs and assemble vectors, staged once for all fits.

    ``train`` carries ``revenue`` and ``cogs`` next to the feature columns. The
    horizon is aligned to the training columns and filled from training medians.
    """
    columns, keys = list(columns), list(keys)
    horizon = align_columns(horizon, [*keys, "date", *columns])
    days = folds.assign_folds(train.select("date"), n_splits).select("date", "fold")
    filled = impute.fill_train_median(train, train, columns, keys, clear_infinite=True)
    ahead = impute.fill_train_median(horizon, train, columns, keys)
    known = filled.join(days, "date").withColumns({f"log_{t}": log_target(t) for t in TARGETS})
    rows, ahead = run_together(
        train.sparkSession,
        [
            lambda: stage(known, "matrix"),
            lambda: stage(trees.assemble(ahead, columns), "horizon_matrix"),
        ],
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fold").alias("k")).first()
    if size["k"] != n_splits + 1:
        raise ValueError(f"too few dates for {n_splits} folds")
    vectors = trees.settle(trees.assemble(rows, columns), size["n"], keys)
    return Matrix(vectors.persist(), ahead, columns, size["n"], tuple(keys))


def begin(matrix: Matrix, config, folder: str) -> Ledger:
    """The ledger of a run over these rows with these settings."""
    ledger = Ledger(matrix.train.sparkSession, folder)
    settings = {k: v for k, v in asdict(config).items() if k != "workers"}
    labels = [f"log_{t}" for t in TARGETS]
    rows = fingerprint(matrix.train.select(*matrix.keys, "date", "fold", *labels, *matrix.columns))
    ledger.belongs_to("run", {"settings": settings, "columns": matrix.columns, **rows})
    return ledger


@dataclass(frozen=True)
class CvResult:
    """Long prediction tables and the rounds each boosted model used."""

    oof: DataFrame  # keys…, date, fold, model, target, pred, actual
    horizon: DataFrame  # keys…, date, fold, model, target, pred
    rounds: list[tuple[int, str, str, int]]


def run_cv(matrix: Matrix, config: ForecastConfig, folder: str | None = None) -> CvResult:
    """Fit every fold, model and target; predict validation rows and the horizon.

    The fits are independent Spark jobs, so a bounded number run at once. Each
    fold's models then score their rows together in one pass.

    ``folder``, a shared one of its own, makes the run restartable: finished forests and blocks
    of boosting are kept there, and a later run over the same rows with the same settings fits
    only what is missing. Other rows or settings are refused.
    """
    spark = matrix.train.sparkSession
    ledger = begin(matrix, config, folder) if folder else None
    folds_ = range(1, config.n_splits + 1)
    cells = {
        (k, spec.name, t): trees.Cell(f"{k}_{spec.name}_{t}", k, f"log_{t}", spec)
        for k in folds_
        for spec in config.specs
        for t in TARGETS
    }
    fitted = boosting.fit_cells(matrix.train, list(cells.values()), matrix.keys, config.workers, ledger)
    used = [(*key, fitted[c.name][1]) for key, c in cells.items()]

    names = {s.name: tuple(f"{s.name}_{t}" for t in TARGETS) for s in config.specs}
    base = [*matrix.keys, "date"]
    validated, ahead = [], []
    for k in folds_:
        models = {
            f"{m}_{t}": fitted[c.name][0] for (f, m, t), c in cells.items() if f == k
        }
        unlogged = {m: unlog(m) for m in models}
        now = matrix.train.filter(F.col("fold") == k).select(*base, *TARGETS, "features")
        for rows, out in ((now, validated), (matrix.horizon.select(*base, "features"), ahead)):
            wide = trees.score_ensembles(rows, models).withColumns(unlogged)
            out.append(
                scoring.melt_predictions(wide, names, matrix.keys).withColumn("fold", F.lit(k))
            )
    oof, horizon = validated[0], ahead[0]
    for a, b in zip(validated[1:], ahead[1:]):
        oof, horizon = oof.unionByName(a), horizon.unionByName(b)
    oof, horizon = run_together(
        spark, [lambda: stage(oof, "oof"), lambda: stage(horizon, "horizon_preds")]
    )
    return CvResult(oof, horizon, used)


def complete_oof(matrix: Matrix, cv: CvResult, config: ForecastConfig) -> DataFrame:
    """Out-of-fold table over all rows; the head no fold validates gets ``oof_fill``."""
    if config.oof_fill is None:
        return cv.oof
    base = [*matrix.keys, "date"]
    head = matrix.train.filter(F.col("fold") == 0).select(*base, "fold", *TARGETS)
    zeros = head.withColumn("_zero", F.lit(float(config.oof_fill)))
    names = {s.name: ("_zero", "_zero") for s in config.specs}
    rows = scoring.melt_predictions(zeros, names, matrix.keys).withColumn("fold", F.lit(0))
    return cv.oof.unionByName(rows)


@dataclass(frozen=True)
class Forecast:
    """Everything a run yields, as DataFrames."""

    forecast: DataFrame  # variant, Date, Revenue, COGS
    best: DataFrame  # variant, total_mape
    fold_scores: DataFrame
    oof_scores: DataFrame
    variant_scores: DataFrame
    weights: DataFrame
    bounds: DataFrame


def stack_inputs(matrix: Matrix, cv: CvResult, config: ForecastConfig):
    """Staged stack matrices: training side with actuals, and the horizon."""
    models = [s.name for s in config.specs]
    keys = list(matrix.keys)
    oof = complete_oof(matrix, cv, config)
    actual = oof.groupBy(*keys, "date", "target").agg(F.max("actual").alias("actual"))
    train = scoring.stack_matrix(oof, models, keys).join(actual, [*keys, "date", "target"])
    ahead = scoring.stack_matrix(scoring.average_folds(cv.horizon, keys), models, keys)
    train = stage(train, "stack_train")
    train = trees.settle(train, train.count(), keys).persist()
    return train, stage(ahead, "stack_horizon"), models


def run_forecast(
    matrix: Matrix, config: ForecastConfig = ForecastConfig(), folder: str | None = None
) -> Forecast:
    """Cross-validate, stack, correct residuals, choose a variant; see ``run_cv`` for ``folder``."""
    spark, keys = matrix.train.sparkSession, list(matrix.keys)
    cv = run_cv(matrix, config, folder)
    train, ahead, models = stack_inputs(matrix, cv, config)

    fits = stack.fit_stack(train, models, config.meta_spec())
    stacked = stage(stack.predict_stack(train, fits, keys), "stacked")
    stacked_ahead = stack.predict_stack(ahead, fits, keys)

    base = [*keys, "date"]
    x_train = matrix.train.select(*base, *matrix.columns)
    x_ahead = matrix.horizon.select(*base, *matrix.columns)
    residual = stack.fit_residual(stacked, x_train, matrix.columns, keys)
    variants = {
        "stack": (stacked, stacked_ahead),
        "stack_residual": (
            stack.predict_residual(stacked, x_train, residual, keys),
            stack.predict_residual(stacked_ahead, x_ahead, residual, keys),
        ),
    }
    scores, forecasts = None, None
    for name, (seen, coming) in variants.items():
        s = scoring.score(seen, ["target"]).withColumn("variant", F.lit(name))
        wide = stack.constrain(stack.to_wide(coming, keys))
        f = stack.format_forecast(wide, keys).withColumn("variant", F.lit(name))
        scores = s if scores is None else scores.unionByName(s)
        forecasts = f if forecasts is None else forecasts.unionByName(f)
    scores = stage(scores, "variant_scores", partitions=1)
    train.unpersist()
    return Forecast(
        forecast=forecasts,
        best=stack.pick_variant(scores, list(variants)),
        fold_scores=scoring.fold_scores(cv.oof),
        oof_scores=scoring.oof_scores(complete_oof(matrix, cv, config)),
        variant_scores=scores,
        weights=stack.stack_weights(fits, spark),
        bounds=folds.fold_bounds(matrix.train.select("date", "fold")),
    )
