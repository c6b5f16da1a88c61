"""Boosted trees that go on where they stopped: a block of rounds at a time, on what is left over.

Each round fits one Spark ML tree to the residuals of the rows seen so far and adds a step of
it to every row's margin. A block's margins are written once, so plans stay short and an
executor that is lost costs a block at most. Early stopping looks at each block's errors, so no
round is fitted twice and few more than the rounds used plus the patience.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.functions.metrics import MAPE_EPS
from dailycast.operators import trees
from dailycast.sources.ledger import Ledger
from dailycast.sources.staging import run_together, stage, stage_path

#: Rounds fitted between two looks at the validation error.
BLOCK = 5
#: Resolution of the draw of a bag.
DRAWS = 1 << 20


@dataclass
class Run:
    """A boosted model in the making: everything needed to go on is here or in the shared folder."""

    base: float
    margins: DataFrame  # keys…, margin
    saved: list[trees.Saved] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    at: list[str] | None = None  # the table of margins and its column, where a later run finds them

    @property
    def rounds(self) -> int:
        return len(self.saved)

    def entry(self) -> dict:
        """What a ledger keeps of the run: its numbers, and where its files lie."""
        return {"base": self.base, "at": self.at, "saved": [[s.path, s.weights] for s in self.saved], "errors": self.errors}


def from_entry(spark: SparkSession, entry: dict, keys: Sequence[str]) -> Run:
    path, column = entry["at"]
    margins = spark.read.parquet(path).select(*keys, F.col(column).alias("margin"))
    return Run(entry["base"], margins, [trees.Saved(*s) for s in entry["saved"]], entry["errors"], entry["at"])


def in_bag(keys: Sequence[str], spec: trees.TreeSpec, round_: int) -> Column:
    """Whether a row is drawn: by its keys, the seed and the bag, which is kept for ``bag_rounds`` rounds."""
    bag = round_ // spec.bag_rounds
    draw = F.pmod(F.xxhash64(*keys, F.lit(spec.seed), F.lit(bag)), F.lit(DRAWS))
    return draw < F.lit(round(spec.row_share * DRAWS))


def leaf_values(rows: DataFrame, leaf: str, residual: str, l2: float) -> list[float]:
    """Values of a tree's leaves, lowest number first: sums of residuals over rows plus ``l2``.

    One row per leaf reaches the driver; every leaf has rows, those that the tree was fitted on.
    """
    sums = rows.groupBy(leaf).agg(F.sum(residual).alias("total"), F.count("*").alias("n"))
    found = {int(r[leaf]): r["total"] / (r["n"] + l2) for r in sums.collect()}
    return [found.get(k, 0.0) for k in range(max(found, default=0) + 1)]


def one_tree(rows: DataFrame, spec: trees.TreeSpec, round_: int) -> RandomForestRegressionModel:
    """A single tree over ``features`` for ``_residual``; the bag is drawn by the caller."""
    return RandomForestRegressor(
        featuresCol="features", labelCol="_residual", leafCol="_leaf", predictionCol="_tree", numTrees=1, bootstrap=False,
        subsamplingRate=1.0, maxDepth=spec.depth, minInstancesPerNode=spec.min_rows, maxBins=spec.bins,
        featureSubsetStrategy=spec.feature_share, seed=spec.seed + round_,
    ).fit(rows)


def start(rows: DataFrame, label: str, fold: int, keys: Sequence[str]) -> Run:
    """No trees yet: every margin is the mean of the rows before ``fold``."""
    base = rows.filter(F.col("fold") < fold).agg(F.avg(label)).first()[0]
    return Run(base, stage(rows.select(*keys, F.lit(base).alias("margin")), "margins"))


def go_on(
    run: Run, rows: DataFrame, label: str, spec: trees.TreeSpec, fold: int, keys: Sequence[str], rounds: int = BLOCK,
    ledger: Ledger | None = None,
) -> Run:
    """``rounds`` more rounds on what the trees so far leave over; rows of ``fold`` are only watched.

    ``rows`` carries ``keys``, which tell its rows apart, ``fold``, ``features`` and ``label``.
    """
    now = rows.select(*keys, "fold", "features", F.col(label).alias("_y")).join(run.margins, list(keys))
    now = now.withColumnRenamed("margin", "_margin_0")
    models = []
    for k in range(rounds):
        at = run.rounds + k
        now = now.withColumn("_residual", F.col("_y") - F.col(f"_margin_{k}"))
        bag = now.filter((F.col("fold") < fold) & in_bag(keys, spec, at))
        model = one_tree(bag.select("features", "_residual"), spec, at)
        models.append(model)
        now = model.transform(now)
        leaf = F.get(vector_to_array("_leaf"), F.lit(0)).cast("int")
        value = F.col("_tree")
        if spec.leaf_l2:
            values = leaf_values(
                now.withColumn("_at", leaf).filter((F.col("fold") < fold) & in_bag(keys, spec, at)), "_at", "_residual", spec.leaf_l2
            )
            value = F.element_at(F.array(*map(F.lit, values)), leaf + 1)
        now = now.withColumn(f"_margin_{k + 1}", F.col(f"_margin_{k}") + F.lit(spec.step) * value).drop("_leaf", "_tree", "_residual")
    margins = [f"_margin_{k}" for k in range(1, rounds + 1)]
    spark = rows.sparkSession
    place = ledger.place if ledger else lambda name: stage_path(spark, name)
    at = [place("margins"), margins[-1]]
    fresh = now.select(*keys, "fold", "_y", *margins)
    fresh.write.parquet(at[0])
    done = spark.read.schema(fresh.schema).parquet(at[0])
    off = [F.avg(F.abs(F.col("_y") - F.col(m)) / (F.abs("_y") + MAPE_EPS)) for m in margins]
    errors = list(done.filter(F.col("fold") == fold).agg(*off).first())
    saved = []
    for model in models:
        path = place("model")
        model.write().save(path)
        saved.append(trees.Saved(path, [spec.step]))
    margin = done.select(*keys, F.col(margins[-1]).alias("margin"))
    return Run(run.base, margin, run.saved + saved, run.errors + errors, at)


def stop_round(errors: Sequence[float], patience: int) -> tuple[int, int, bool]:
    """Best round, the one at which training stops, and whether patience ended it; rounds from 1."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        if k - best >= patience:
            return best + 1, k + 1, True
    return best + 1, len(errors), False


def fit_cell(
    rows: DataFrame, cell: trees.Cell, keys: Sequence[str], block: int = BLOCK, ledger: Ledger | None = None
) -> tuple[Run, int]:
    """Boost until the watched error stops improving; the run and how many of its rounds count.

    With a ledger every finished block is an entry, and an earlier run's last one is where this
    one begins.
    """
    spec = cell.spec
    seen = rows.filter(F.col("fold") <= cell.fold)
    begun = ledger.recall(cell.name) if ledger else None
    run = from_entry(rows.sparkSession, begun, keys) if begun else start(seen, cell.label, cell.fold, keys)
    while True:
        if run.rounds:
            best, stop, stopped = stop_round(run.errors, spec.patience or spec.max_rounds)
            if stopped or run.rounds >= spec.max_rounds:
                return run, best if spec.keep_best and spec.patience else stop
        run = go_on(run, seen, cell.label, spec, cell.fold, keys, min(block, spec.max_rounds - run.rounds), ledger)
        if ledger:
            ledger.record(cell.name, run.entry())


def with_base(run: Run, single: Sequence[trees.Ensemble], spec: trees.TreeSpec) -> trees.Ensemble:
    """Single trees as one model, after one leaf that holds the base; leaves shrunk as in the fit."""
    out = trees.Ensemble([1.0], *[[np.array([x])] for x in (0, 0.0, -1, -1, run.base, 1.0)])
    for tree in single:
        for f in ("weights", "feature", "threshold", "left", "right", "rows"):
            getattr(out, f).extend(getattr(tree, f))
        n = tree.rows[0]
        out.value.append(tree.value[0] * n / (n + spec.leaf_l2))
    return out


def load(run: Run, spec: trees.TreeSpec, used: int) -> trees.Ensemble:
    """The model's first ``used`` rounds as node arrays."""
    return load_all(run.margins.sparkSession, {"run": (run, spec, used)})["run"]


def load_all(spark: SparkSession, runs: dict[str, tuple[Run, trees.TreeSpec, int]]) -> dict[str, trees.Ensemble]:
    """Several models, their trees read in one scan."""
    saved = {(name, k): s for name, (run, _, used) in runs.items() for k, s in enumerate(run.saved[:used])}
    number = {key: str(i) for i, key in enumerate(saved)}
    found = trees.load_ensembles(trees.node_tables(spark, {number[key]: s for key, s in saved.items()})) if saved else {}
    return {
        name: with_base(run, [found[number[name, k]] for k in range(used)], spec) for name, (run, spec, used) in runs.items()
    }


def fit_cells(
    train: DataFrame, cells: Sequence[trees.Cell], keys: Sequence[str] = (), workers: int = 8, ledger: Ledger | None = None
) -> dict[str, tuple[trees.Ensemble, int]]:
    """Fit every cell, a bounded number at once: forests whole, boosted ones until their fold stops improving.

    What ``ledger`` has of an earlier run over the same rows is not fitted again.
    """
    spark, on = train.sparkSession, [*keys, "date"]

    def one(c: trees.Cell):
        if c.spec.kind != "forest":
            return fit_cell(train, c, on, ledger=ledger)
        past = train.filter(F.col("fold") < c.fold)
        if not ledger:
            return trees.save(trees.fit(past, c.label, c.spec))
        done = ledger.recall(c.name)
        if done is None:
            saved = trees.save(trees.fit(past, c.label, c.spec), ledger.place("model"))
            done = ledger.record(c.name, {"path": saved.path, "weights": saved.weights})
        return trees.Saved(done["path"], done["weights"])

    fitted = dict(zip([c.name for c in cells], run_together(spark, [lambda c=c: one(c) for c in cells], workers)))
    forests = {c.name: fitted[c.name] for c in cells if c.spec.kind == "forest"}
    boosted = {c.name: (fitted[c.name][0], c.spec, fitted[c.name][1]) for c in cells if c.spec.kind != "forest"}
    models = trees.load_ensembles(trees.node_tables(spark, forests)) if forests else {}
    models |= load_all(spark, boosted)
    return {c.name: (models[c.name], boosted[c.name][2] if c.name in boosted else len(models[c.name])) for c in cells}
