"""Expanding time folds over the distinct dates of a history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dailycast.operators.attach import attach_row

N_SPLITS = 5


def date_positions(dates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based position of every distinct date.

    Rank within the year plus the dates of all earlier years: no window spans
    more than one year of dates, and the running total is at year grain.
    """
    days = dates.select(*keys, "date").filter(F.col("date").isNotNull()).distinct()
    days = days.withColumn("_y", F.year("date"))
    before = Window.partitionBy(*keys).orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    per_year = days.groupBy(*keys, "_y").agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_year.select(
        *keys, "_y", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    side = offsets if keys else F.broadcast(offsets)  # one row per year
    rank = F.row_number().over(Window.partitionBy(*keys, "_y").orderBy("date"))
    return (
        days.withColumn("_rank", rank)
        .join(side, [*keys, "_y"])
        .select(*keys, "date", (F.col("_before") + F.col("_rank") - 1).alias("position"))
    )


def with_position(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Attach each row's place in date order."""
    return df.join(date_positions(df, keys), [*keys, "date"])


def assign_folds(dates: DataFrame, n_splits: int = N_SPLITS) -> DataFrame:
    """``date, position, fold``: validation fold 1..n, or 0 for the head.

    Fold k is validated on its own dates and trained on every earlier one, so
    ``fold < k`` is its training set. All series share the cut dates.
    """
    pos = date_positions(dates)
    size = pos.agg(F.count(F.lit(1)).alias("_n"))
    test = F.floor(F.col("_n") / F.lit(n_splits + 1))
    step = F.col("position") - (F.col("_n") - F.lit(n_splits) * test)
    fold = F.when(step < 0, F.lit(0)).otherwise(F.floor(F.try_divide(step, test)) + F.lit(1))
    return attach_row(pos, size).select("date", "position", fold.cast("int").alias("fold"))


def fold_bounds(folds: DataFrame) -> DataFrame:
    """Training and validation range of every fold."""
    own = folds.groupBy("fold").agg(F.min("date").alias("val_start"), F.max("date").alias("val_end"))
    earlier = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # n + 1 rows
    return (
        own.select(
            "fold",
            F.min("val_start").over(earlier).alias("train_start"),
            F.max("val_end").over(earlier).alias("train_end"),
            "val_start",
            "val_end",
        )
        .filter(F.col("fold") > 0)
    )


def in_fold_range(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Tag rows with the fold whose validation range holds their date.

    The ``n_splits`` ranges travel as one array literal and each row keeps those
    that match, so the interval match needs neither a shuffle nor a join.
    """
    ranges = bounds.agg(F.collect_list(F.struct("fold", "val_start", "val_end")).alias("_ranges"))
    hits = "filter(_ranges, r -> date between r.val_start and r.val_end)"
    return attach_row(rows, ranges).selectExpr(
        *rows.columns, f"explode({hits}) as _hit"
    ).selectExpr(*rows.columns, "_hit.fold as fold")
