"""Joining small derived tables to daily rows without a cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.sources.staging import stage


def attach_stats(
    df: DataFrame, stats: DataFrame, on: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Left-attach statistics per calendar slot: ``on`` names integer slot columns.

    For one series such a table has at most one row per slot (366 month-days, 12
    months, 7 weekdays, one row per year), a bound that holds at any data size, so
    it is broadcast.

    With series keys it grows with the number of series. Then each series' slots,
    bounded as before, are packed into one map and joined on the keys alone: rows
    that are already partitioned and sorted by series stay where they are, however
    many of these tables are attached.
    """
    if not keys:
        return df.join(F.broadcast(stats), list(on), "left")
    values = [c for c in stats.columns if c not in {*keys, *on}]
    slot = on[0]
    for c in on[1:]:
        slot = f"({slot}) * 1000 + {c}"
    entry = f"struct({slot} as slot, struct({', '.join(values)}) as hit)"
    packed = stats.groupBy(*keys).agg(
        F.expr(f"map_from_entries(collect_list({entry}))").alias("_slots")
    )
    joined = df.join(packed, list(keys), "left")
    return joined.selectExpr(*df.columns, f"_slots[{slot}] as _hit").selectExpr(
        *df.columns, *[f"_hit.{c} as {c}" for c in values]
    )


def attach_row(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Attach per-series scalars: one row in all, or one row per series.

    The single row becomes a scalar subquery: it runs once and reaches the tasks
    as a literal, so neither a nested-loop join nor a driver-side fetch is needed.
    """
    if keys:
        return df.join(stats, list(keys), "left")
    packed = stats.select(F.struct("*")).scalar()
    return df.withColumn("_row", packed).select("*", "_row.*").drop("_row")


def heavy_left_join(
    left: DataFrame, right: DataFrame, on: str, weight: str, spread: str, share: int = 1024, least: int = 100_000
) -> DataFrame:
    """Left join in which only the keys with very many left rows are split over several tasks.

    ``right`` has one row per key, and ``weight``, the number of left rows that the aggregation
    behind it has counted with the rest. A key is heavy from ``least`` rows and a ``share``-th of
    all on; there are at most ``share`` such keys, so their list is broadcast. Rows of a heavy key draw
    one of its salts from ``spread``, and only its right row is repeated, once per salt: all
    copies together are at most twice ``share``. Other keys move once, unsplit. Left rows
    without a key, however many, are spread like those of a heavy one. ``weight`` is dropped.
    """
    right = stage(right, "weighted")
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    limit = max(least, -(-total // share))
    salts = F.when(F.col(weight) >= limit, F.ceil(F.col(weight) / limit)).otherwise(1).cast("int")
    heavy = right.filter(F.col(weight) >= limit).select(F.col(on), salts.alias("_salts"))
    draw = F.xxhash64(spread)
    salt = F.when(F.col(on).isNull(), F.pmod(draw, F.lit(share))).otherwise(F.pmod(draw, F.coalesce("_salts", F.lit(1))))
    salted = left.join(F.broadcast(heavy), on, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(weight)
    return salted.join(copies, [on, "_salt"], "left").drop("_salt")
