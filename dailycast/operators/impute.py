"""Filling missing values from exact medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.operators.attach import attach_row


def medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact medians of all columns in one aggregation; one row per series.

    The state of an exact median is a count per distinct value. At daily grain
    that is at most one entry per calendar day of the series.
    """
    packed = ", ".join(f"median({c}) as {c}" for c in cols)
    return df.groupBy(*keys).agg(F.expr(f"struct({packed})").alias("_m")).select(*keys, "_m.*")


def fill_from(
    df: DataFrame,
    stats: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = (),
    then_zero: bool = False,
    clear_infinite: bool = False,
) -> DataFrame:
    """Fill ``cols`` from a one-row-per-series table of stand-in values.

    ``clear_infinite`` treats infinities as missing; ``then_zero`` covers columns
    that have no stand-in because they are NULL throughout.
    """
    packed = ", ".join(cols)
    rows = attach_row(df, stats.selectExpr(*keys, f"struct({packed}) as _fill"), keys)
    zero = ", 0D" if then_zero else ""
    out = []
    for c in df.columns:
        value = f"if(abs({c}) < double('inf'), {c}, null)" if clear_infinite else c
        out.append(f"coalesce({value}, _fill.{c}{zero}) as {c}" if c in set(cols) else c)
    return rows.selectExpr(*out)


def fill_own_median(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each table is filled from its own medians, never from another's."""
    return fill_from(df, medians(df, cols, keys), cols, keys)


def fill_train_median(
    df: DataFrame,
    train: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = (),
    clear_infinite: bool = False,
) -> DataFrame:
    """The training medians, then zero, for training and horizon alike."""
    return fill_from(
        df,
        medians(train, cols, keys),
        cols,
        keys,
        then_zero=True,
        clear_infinite=clear_infinite,
    )
