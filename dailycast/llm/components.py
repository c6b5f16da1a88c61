"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.sources.staging import stage


def _state(edges: DataFrame):
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); a root is its component's least node.

    Edges point from larger to smaller nodes. A large star hangs a node's larger
    neighbours on its least one, a small star does so with the smaller ones; both keep
    components and need few rounds. Minima are combined before the shuffle and joined
    back, so a hub's neighbours never meet in one group. Links that no table holds, loops and
    repeats are left out. Every round is written, so no lineage grows.
    """
    edges = stage(
        links.filter("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")
        )
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
