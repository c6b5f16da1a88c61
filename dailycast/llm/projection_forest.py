"""Approximate nearest neighbours from a forest of random-projection trees.

Trees are fitted on a bounded sample; every row is indexed in every tree. A query searches
all trees through one priority queue, nearest margin first, until it has seen ``visits``
leaves. Queries meet the rows of their leaves in groups of bounded size, where exact inner
products rank them.
"""

import heapq
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.sources.staging import stage

#: Sampled vectors the trees are fitted on, sampled vectors of a leaf, trees, leaves a query visits.
SAMPLE, LEAF, TREES, VISITS = 20_000, 320, 16, 120
#: Rows, and queries, of one group; larger leaves are split into several.
GROUP = 20_000


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors, one dimension more, whose angles order inner products with a query."""
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))])


class Tree:
    """Nodes in arrays: normal and threshold of a split, the children, or a leaf's number."""

    def __init__(self, x: np.ndarray, rng, leaf: int):
        self.normal, self.cut, self.low, self.high, self.leaf = [], [], [], [], []
        self.leaves = 0
        self._grow(x, np.arange(len(x)), rng, leaf)
        self.normal, self.cut = np.array(self.normal, np.float32), np.array(self.cut, np.float32)

    def _grow(self, x, rows, rng, size: int) -> int:
        k = len(self.cut)
        for column, value in ((self.normal, np.zeros(x.shape[1])), (self.cut, 0.0), (self.low, -1), (self.high, -1), (self.leaf, -1)):
            column.append(value)
        split = self._split(x[rows], rng) if len(rows) > size else None
        if split is None:
            self.leaf[k] = self.leaves
            self.leaves += 1
            return k
        normal, cut = split
        up = x[rows] @ normal >= cut
        self.normal[k], self.cut[k] = normal, cut
        self.low[k] = self._grow(x, rows[~up], rng, size)
        self.high[k] = self._grow(x, rows[up], rng, size)
        return k

    @staticmethod
    def _split(x, rng):
        """A hyperplane between two random rows, settled by three rounds of two means."""
        a, b = x[rng.choice(len(x), 2, replace=False)].astype(np.float32)
        for _ in range(3):
            at = x @ (b - a)
            up = at >= np.median(at)
            if up.all() or not up.any():
                return None  # as good as equal: no plane divides them
            a, b = x[~up].mean(axis=0), x[up].mean(axis=0)
        normal = ((b - a) / (np.linalg.norm(b - a) + 1e-12)).astype(np.float32)
        at = x @ normal
        cut = np.float32(np.median(at))
        up = at >= cut
        return None if up.all() or not up.any() else (normal, cut)

    def find(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            k, rows = stack.pop()
            if self.leaf[k] >= 0:
                out[rows] = self.leaf[k]
                continue
            up = x[rows] @ self.normal[k] >= self.cut[k]
            stack += [(self.low[k], rows[~up]), (self.high[k], rows[up])]
        return out


class Forest:
    def __init__(self, sample: np.ndarray, longest: float, trees: int = TREES, leaf: int = LEAF):
        rng = np.random.default_rng(11)
        self.longest = longest
        x = lift(sample, longest).astype(np.float32)
        self.trees = [Tree(x, rng, leaf) for _ in range(trees)]
        self.first = np.cumsum([0, *[t.leaves for t in self.trees]])[:-1].tolist()

    def leaves(self, x: np.ndarray) -> np.ndarray:
        y = lift(x, self.longest).astype(np.float32)
        return np.column_stack([t.find(y) + f for t, f in zip(self.trees, self.first)])

    def search(self, query: np.ndarray, visits: int) -> list[int]:
        """Leaves in the order of one queue over all trees; a side's priority is its least margin."""
        q = np.append(query / np.linalg.norm(query), 0).astype(np.float32)
        margins = [t.normal @ q - t.cut for t in self.trees]
        queue = [(-math.inf, t, 0) for t in range(len(self.trees))]
        found: list[int] = []
        while queue and len(found) < visits:
            worst, t, k = heapq.heappop(queue)
            tree = self.trees[t]
            if tree.leaf[k] >= 0:
                found.append(self.first[t] + tree.leaf[k])
                continue
            m = float(margins[t][k])
            heapq.heappush(queue, (max(worst, -m), t, tree.high[k]))
            heapq.heappush(queue, (max(worst, m), t, tree.low[k]))
        return found


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows that take part: an id, the table's usual number of components, all finite, not all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(
        F.col("id").isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & F.exists(v, lambda x: x != 0)
    )
    usual = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size(v) == (usual["n"] if usual else -1))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(k: int):
    """Of one group, each query's ``k`` nearest rows, exact scores, ties to smaller ids."""

    def rank(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids = rows["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(rows["v"])[order]
            asked, y = queries["query_id"].to_numpy(), _matrix(queries["q"])
            for i in range(0, len(asked), 512):
                near = y[i : i + 512] @ x.T
                near[asked[i : i + 512, None] == ids[None, :]] = -np.inf
                for a, q, s in zip(asked[i : i + 512].tolist(), y[i : i + 512], near):
                    at = np.arange(len(ids)) if len(ids) <= k else np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-9)
                    at = at[s[at] > -np.inf]
                    exact = (x[at] * q).sum(axis=1)
                    best = np.lexsort((ids[at], -exact))[:k]
                    out += [(a, v, z) for v, z in zip(ids[at][best].tolist(), exact[best].tolist())]
        columns = list(zip(*out)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, kinds)})

    return rank


_WORKER: dict = {}


def nearest(
    vectors: DataFrame,
    query,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    sample: int = SAMPLE,
    visits: int = VISITS,
) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the ``k`` nearest rows found for each query.

    ``query`` is a condition on ``id``; all usable rows (see ``usable``) are candidates but
    those with the query's own id. Score is the inner product in double precision; ties go to
    smaller ids; rows that repeat an id count once, by their best score. A query with fewer
    candidates gets them all. Null or unusable vectors and empty tables give no rows; other
    columns are not looked at. Trees hold ``sample`` rows at most, whatever the table's size.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, vec_id, embedding), "vectors")
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()
    forest = Forest(np.array(chosen["v"].tolist()), math.sqrt(longest))
    shared, key = spark.sparkContext.broadcast(pickle.dumps(forest)), uuid.uuid4().hex

    def held() -> Forest:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = pickle.loads(shared.value)
        return _WORKER[key]

    def index(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            leaves = held().leaves(_matrix(batch)).astype(np.int32) if len(batch) else np.zeros((0, 1), np.int32)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * leaves.shape[1]
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(leaves.ravel()))

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [held().search(q, visits) for q in _matrix(batch)] if len(batch) else []
            yield pa.array(found, pa.list_(pa.int32()))

    indexed = stage(rows.select("id", "v", F.arrow_udf(index, "array<int>")(F.col("v")).alias("leaves")), "forest_index")
    asked = stage(
        rows.filter(query).select("id", "v", F.arrow_udf(search, "array<int>")(F.col("v")).alias("leaves")), "searches"
    )

    def parts(df: DataFrame, name: str) -> DataFrame:
        """How many groups the rows of each leaf make; at most a row for each leaf of the forest."""
        return F.broadcast(
            stage(
                df.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(
                    F.ceil(F.count("*") / GROUP).cast("int").alias(name)
                ),
                name,
            )
        )

    row_parts, query_parts = parts(indexed, "row_parts"), parts(asked, "query_parts")
    entries = (
        indexed.select(F.explode("leaves").alias("leaf"), "id", "v")
        .join(row_parts, "leaf")
        .join(query_parts, "leaf")
        .withColumn("row_part", F.pmod(F.xxhash64("id", F.lit(1)), "row_parts").cast("int"))
        .withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
        .select("leaf", "row_part", "query_part", "id", "v")
    )
    questions = (
        asked.select(F.explode("leaves").alias("leaf"), F.col("id").alias("query_id"), F.col("v").alias("q"))
        .join(row_parts, "leaf")
        .join(query_parts, "leaf")
        .withColumn("query_part", F.pmod(F.xxhash64("query_id", F.lit(2)), "query_parts").cast("int"))
        .withColumn("row_part", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)))
        .select("leaf", "row_part", "query_part", "query_id", "q")
    )
    group = ["leaf", "row_part", "query_part"]
    found = (
        entries.groupBy(*group)
        .cogroup(questions.groupBy(*group))
        .applyInArrow(_best(k), "query_id long, vec_id long, score double")
    )
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = once.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best")
    )
    ranked = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.s")).alias("score"),
    )
