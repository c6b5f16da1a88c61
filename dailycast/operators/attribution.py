"""Exact Shapley attribution of tree ensembles, computed where the rows are.

A leaf is reached when every feature on its path lies in an interval. Seen as a
cooperative game over those features, a leaf pays its value when all known
features lie in their intervals, and the share of training rows that took the
path for each unknown one. With o = 1 inside and 0 outside and z the share, a
feature's Shapley value in such a product game is (o - z) times the integral over
t in [0, 1] of the other features' product of z (1 - t) + o t: a polynomial whose
degree is the number of others, so half as many Gauss nodes integrate it exactly.
The cost is quadratic in the depth, and every term is a sum of positive numbers.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dailycast.operators.trees import Ensemble, as_matrix

#: Numbers of an array worked on at once, and rows of a block.
BLOCK, ROWS = 2_000_000, 1_000


@dataclass
class Leaves:
    """Leaves whose paths use the same number of distinct features."""

    feature: np.ndarray  # leaf x slot
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray  # leaf


def leaf_groups(model: Ensemble) -> tuple[float, list[Leaves]]:
    """Expected value of the model and its leaves as boxes, grouped by width."""
    base, found = 0.0, defaultdict(list)
    for t, weight in enumerate(model.weights):
        stack = [(0, {})]
        while stack:
            node, box = stack.pop()
            if model.left[t][node] < 0:
                value = weight * model.value[t][node]
                base += value * math.prod(b[2] for b in box.values())
                if box:
                    found[len(box)].append((box, value))
                continue
            f, cut = int(model.feature[t][node]), model.threshold[t][node]
            low, high, share = box.get(f, (-math.inf, math.inf, 1.0))
            for child, lo, hi in (
                (model.left[t][node], low, min(high, cut)),
                (model.right[t][node], max(low, cut), high),
            ):
                part = model.rows[t][child] / model.rows[t][node]
                stack.append((int(child), {**box, f: (lo, hi, share * part)}))
    groups = []
    for members in found.values():
        sides = [list(box.values()) for box, _ in members]
        groups.append(
            Leaves(
                feature=np.array([list(box) for box, _ in members]),
                low=np.array([[s[0] for s in side] for side in sides]),
                high=np.array([[s[1] for s in side] for side in sides]),
                share=np.array([[s[2] for s in side] for side in sides]),
                value=np.array([v for _, v in members]),
            )
        )
    return base, groups


def nodes_of(width: int) -> list[tuple[float, float]]:
    """Places and weights on [0, 1] that integrate polynomials of degree ``width - 1`` exactly."""
    place, weight = np.polynomial.legendre.leggauss((width + 1) // 2)
    return [((p + 1) / 2, w / 2) for p, w in zip(place.tolist(), weight.tolist())]


def leaf_shapley(inside: list[np.ndarray], share: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    """Shapley values of leaves for rows: per slot, a row x leaf array.

    ``inside`` has a row x leaf array per slot, ``share`` is leaf x slot.
    """
    width = len(inside)
    total = [np.zeros_like(inside[0]) for _ in range(width)]
    for t, weight in nodes_of(width):
        factors = [share[:, j] * (1 - t) + inside[j] * t for j in range(width)]
        after = [None] * width  # products of the factors behind each slot
        for j in range(width - 1, 0, -1):
            after[j - 1] = factors[j] if after[j] is None else factors[j] * after[j]
        before = weight
        for j in range(width):
            total[j] += before if after[j] is None else before * after[j]
            before = before * factors[j]
    return [(inside[j] - share[:, j]) * value * total[j] for j in range(width)]


def attribute_block(x: np.ndarray, groups: list[Leaves], n_features: int) -> np.ndarray:
    """Attributions of a block of rows: row x feature."""
    phi = np.zeros((len(x), n_features))
    for g in groups:
        n_leaves, width = g.feature.shape
        step = max(1, BLOCK // max(1, len(x) * width))
        for a in range(0, n_leaves, step):
            part = slice(a, a + step)
            feature = g.feature[part]
            inside = []
            for j in range(width):
                v = x[:, feature[:, j]]
                inside.append(((v > g.low[part, j]) & (v <= g.high[part, j])).astype(np.float64))
            for j, paid in enumerate(leaf_shapley(inside, g.share[part], g.value[part])):
                order = np.argsort(feature[:, j], kind="stable")
                used, first = np.unique(feature[order, j], return_index=True)
                phi[:, used] += np.add.reduceat(paid[:, order], first, axis=1)
    return phi


def attribute(df: DataFrame, model: Ensemble, n_features: int) -> DataFrame:
    """Per-row attributions as ``phi`` (one entry per feature) and the ``base`` value.

    ``phi`` sums with ``base`` to the model's raw prediction of the row.
    """
    shared = df.sparkSession.sparkContext.broadcast(leaf_groups(model))
    kept = [c for c in df.columns if c != "features"]

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, groups = shared.value
        for b in batches:
            out = b[kept].copy()
            x = as_matrix(b["_x"])
            blocks = [attribute_block(x[i : i + ROWS], groups, n_features) for i in range(0, len(x), ROWS)]
            out["phi"] = [row for block in blocks for row in block]
            out["base"] = base
            yield out

    rows = df.withColumn("_x", vector_to_array("features")).select(*kept, "_x")
    schema = df.select(*kept).schema.add("phi", T.ArrayType(T.DoubleType())).add("base", "double")
    return rows.mapInPandas(explain, schema)


def mean_abs(attributed: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, score``: mean absolute attribution over all rows.

    Vectors are added element by element where the rows are; one row a task is exchanged.
    """
    means = [F.avg(F.abs(F.get("phi", F.lit(i)))).alias(f"_{i}") for i in range(len(columns))]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("score")) for i, c in enumerate(columns)])
    return attributed.agg(*means).select(F.explode(cells).alias("_c")).select("_c.*")
