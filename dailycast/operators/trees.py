"""Tree ensembles on log targets: fitting, node tables, staged scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.functions.metrics import MAPE_EPS
from dailycast.sources.staging import stage_path

ROWS_PER_PARTITION = 200_000


@dataclass(frozen=True)
class TreeSpec:
    """Hyperparameters of one base model; ``max_rounds`` is the number of trees."""

    name: str
    kind: str  # "forest" or "boosted"
    max_rounds: int
    depth: int
    min_rows: int
    feature_share: str
    step: float = 1.0
    row_share: float = 1.0
    bins: int = 64
    seed: int = 42
    patience: int | None = None
    keep_best: bool = False  # predict at the best round, or with all trained rounds
    bag_rounds: int = 1  # rounds that keep the same draw of rows
    leaf_l2: float = 0.0  # rows that a leaf's mean is shrunk by


# The hyperparameters of the three base models.
FOREST = TreeSpec("rf", "forest", max_rounds=200, depth=8, min_rows=5, feature_share="sqrt")
DEEP = TreeSpec(
    "lgb", "boosted", max_rounds=2000, depth=6, min_rows=20, feature_share="0.8",
    step=0.03, row_share=0.8, patience=50, keep_best=True, bag_rounds=5,
)
SHALLOW = TreeSpec(
    "xgb", "boosted", max_rounds=800, depth=4, min_rows=3, feature_share="0.8",
    step=0.03, row_share=0.8, patience=50, leaf_l2=1.0,
)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Pack numeric columns into one vector; they must be free of NULLs by now."""
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def settle(df: DataFrame, rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """Fix the partitioning and order that tree fits depend on.

    Hash partitioning by date is the same on every run, and the partition count
    follows the number of rows, so a fit repeats exactly on the same data.
    """
    n = max(1, math.ceil(rows / ROWS_PER_PARTITION))
    return df.repartition(n, *keys, "date").sortWithinPartitions(*keys, "date")


def fit(df: DataFrame, label: str, spec: TreeSpec, rounds: int | None = None):
    """Fit one ensemble on ``features`` as a Spark ML job."""
    common = dict(
        featuresCol="features",
        labelCol=label,
        maxDepth=spec.depth,
        minInstancesPerNode=spec.min_rows,
        featureSubsetStrategy=spec.feature_share,
        maxBins=spec.bins,
        seed=spec.seed,
    )
    if spec.kind == "forest":
        est = RandomForestRegressor(numTrees=rounds or spec.max_rounds, **common)
    else:
        est = GBTRegressor(
            maxIter=rounds or spec.max_rounds,
            stepSize=spec.step,
            subsamplingRate=spec.row_share,
            **common,
        )
    return est.fit(df)


@dataclass(frozen=True)
class Saved:
    """Where a fitted model was written, and the weights of its trees."""

    path: str
    weights: list[float]


def save(model, path: str | None = None) -> Saved:
    path = path or stage_path(SparkSession.active(), "model")
    model.write().save(path)
    return Saved(path, _weights(model))


def node_tables(spark: SparkSession, saved: dict[str, Saved]) -> DataFrame:
    """One row per node of every model: ``model, tree, weight, id, feature, …``.

    All models are read in one scan, told apart by the folder they lie in.
    """
    folders = {s.path.rsplit("/", 1)[1]: name for name, s in saved.items()}
    owner = spark.createDataFrame(
        [
            (folder, name, i, float(w))
            for folder, name in folders.items()
            for i, w in enumerate(saved[name].weights)
        ],
        "folder string, model string, tree int, weight double",
    )
    nodes = spark.read.parquet(*[f"{s.path}/data" for s in saved.values()]).selectExpr(
        "element_at(split(_metadata.file_path, '/'), -3) as folder",
        "treeID as tree",
        "nodeData.id as id",
        "nodeData.prediction as value",
        "nodeData.rawCount as n_rows",
        "nodeData.gain as gain",
        "nodeData.leftChild as left",
        "nodeData.rightChild as right",
        "nodeData.split.featureIndex as feature",
        "get(nodeData.split.leftCategoriesOrThreshold, 0) as threshold",
    )
    return nodes.join(F.broadcast(owner), ["folder", "tree"]).drop("folder")  # a row per tree


def node_table(spark: SparkSession, model) -> DataFrame:
    return node_tables(spark, {"model": save(model)}).drop("model")


def _weights(model) -> list[float]:
    """A forest averages its trees, a boosted model adds them with their own weights."""
    w = list(model.treeWeights)
    total = sum(w)
    return [x / total for x in w] if "RandomForest" in type(model).__name__ else w


@dataclass
class Ensemble:
    """Node arrays per tree. Their size follows the hyperparameters, not the data."""

    weights: list[float]
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    right: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.weights)

    def prefix(self, rounds: int) -> Ensemble:
        """The model as it stood after ``rounds`` trees."""
        cut = slice(0, rounds)
        return Ensemble(*[getattr(self, f)[cut] for f in self.__dataclass_fields__])

    def tree_output(self, t: int, x: np.ndarray) -> np.ndarray:
        """Weighted output of tree ``t`` for a block of rows, walked level by level."""
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        left, right = self.left[t], self.right[t]
        while True:
            inner = left[at] >= 0
            if not inner.any():
                return self.weights[t] * self.value[t][at]
            here = at[inner]
            goes_left = x[rows[inner], self.feature[t][here]] <= self.threshold[t][here]
            at[inner] = np.where(goes_left, left[here], right[here])

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in range(len(self)):
            total += self.tree_output(t, x)
        return total


def load_ensembles(nodes: DataFrame) -> dict[str, Ensemble]:
    """Bring node tables to the driver (model-sized, see ``Ensemble``)."""
    table = nodes.toPandas().sort_values(["model", "tree", "id"])
    out: dict[str, Ensemble] = {}
    for (name, _), t in table.groupby(["model", "tree"], sort=True):
        e = out.setdefault(name, Ensemble(weights=[]))
        e.weights.append(float(t["weight"].iloc[0]))
        e.feature.append(t["feature"].to_numpy(np.int64))
        e.threshold.append(t["threshold"].to_numpy(np.float64))
        e.left.append(t["left"].to_numpy(np.int64))
        e.right.append(t["right"].to_numpy(np.int64))
        e.value.append(t["value"].to_numpy(np.float64))
        e.rows.append(t["n_rows"].to_numpy(np.float64))
    return out


def load_ensemble(nodes: DataFrame) -> Ensemble:
    return load_ensembles(nodes.withColumn("model", F.lit("model")))["model"]


def as_matrix(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_numpy()) if len(batch) else np.empty((0, 0))


def score_ensembles(df: DataFrame, ensembles: dict[str, Ensemble]) -> DataFrame:
    """Add one raw prediction column per ensemble in a single pass over the rows."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ensembles)
    names = list(ensembles)
    kept = [c for c in df.columns if c != "features"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = as_matrix(b["_x"])
            out = b[kept].copy()
            for name in names:
                out[name] = shared.value[name].predict(x) if len(b) else np.empty(0)
            yield out

    rows = df.withColumn("_x", vector_to_array("features")).select(*kept, "_x")
    schema = df.select(*kept).schema
    for name in names:
        schema = schema.add(name, "double")
    return rows.mapInPandas(score, schema)


@dataclass(frozen=True)
class Cell:
    """One fit: trained on the folds before ``fold``, watched on ``fold`` itself."""

    name: str
    fold: int
    label: str
    spec: TreeSpec


def round_curves(df: DataFrame, cells: Sequence[Cell], models: dict[str, Ensemble]) -> DataFrame:
    """``model, round, mape`` of every cell on its own fold, in one pass over the rows.

    Tasks return one partial sum per model, round and batch, never a row per
    round and input row.
    """
    wanted = {c.name: models[c.name] for c in cells}
    shared = df.sparkSession.sparkContext.broadcast(wanted)
    by_fold: dict[int, list[Cell]] = {}
    for c in cells:
        by_fold.setdefault(c.fold, []).append(c)
    labels = sorted({c.label for c in cells})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for fold, rows in b.groupby("fold"):
                x = as_matrix(rows["_x"])
                for c in by_fold.get(fold, []):
                    y = rows[c.label].to_numpy(np.float64)
                    scale, running, errors = np.abs(y) + MAPE_EPS, np.zeros(len(y)), []
                    for t in range(len(shared.value[c.name])):
                        running = running + shared.value[c.name].tree_output(t, x)
                        errors.append(float(np.sum(np.abs(y - running) / scale)))
                    rounds = np.arange(1, len(errors) + 1)
                    yield pd.DataFrame(
                        {"model": c.name, "round": rounds, "error": errors, "n": len(y)}
                    )

    rows = df.filter(F.col("fold").isin(list(by_fold))).select(
        "fold", *labels, vector_to_array("features").alias("_x")
    )
    return (
        rows.mapInPandas(partial, "model string, round int, error double, n long")
        .groupBy("model", "round")
        .agg(F.try_divide(F.sum("error"), F.sum("n")).alias("mape"))
    )


def impurity_importance(spark: SparkSession, model, columns: Sequence[str]) -> DataFrame:
    """``feature, score`` as the model reports it; one row per feature."""
    scores = model.featureImportances.toArray()
    return spark.createDataFrame(
        [(c, float(s)) for c, s in zip(columns, scores)], "feature string, score double"
    )


def gain_importance(
    spark: SparkSession, nodes: DataFrame, columns: Sequence[str], how: str = "sum"
) -> DataFrame:
    """Total (``sum``) or per-split (``avg``) gain of each feature from a node table.

    Features no tree split on score zero.
    """
    names = spark.createDataFrame(list(enumerate(columns)), "feature_id int, feature string")
    gain = F.col("gain") * F.col("n_rows")
    agg = F.sum(gain) if how == "sum" else F.avg(gain)
    by_feature = (
        nodes.filter(F.col("left") >= 0)
        .groupBy(F.col("feature").alias("feature_id"))
        .agg(agg.alias("score"))
    )
    return names.join(by_feature, "feature_id", "left").select(
        "feature", F.coalesce("score", F.lit(0.0)).alias("score")
    )
