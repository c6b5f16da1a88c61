"""Exact quantiles of columns with any number of distinct values, by refining range histograms.

Each pass counts rows per range of values on the map side and keeps only the ranges that hold a
wanted rank. No task and no driver ever holds a column's values: what moves is one row per
range, at most ``RANGES`` + 1 of them for each quantile still open. The first pass deals values
by sign and power of two, every later one cuts a range into equal parts, so a double is pinned
down after six passes whatever the values are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a pass cuts an open range into.
RANGES = 4096
#: Beyond every power of two: the ranges of infinities and of NaN.
_INFINITE, _NAN = 5000, 6000


@dataclass
class Open:
    """A range of one column that holds wanted ranks; ranks count from its smallest value."""

    column: str
    low: float
    high: float
    ranks: dict[int, int]  # wanted rank in the column -> rank within the range


def _power_range(v: Column) -> Column:
    """Number of a value's sign and power of two; never falls as the value grows."""
    size = F.abs(v)
    power = F.when(size == float("inf"), _INFINITE).otherwise(F.floor(F.log2(size)).cast("int") + 2000)
    return F.when(F.isnan(v), _NAN).when(v == 0, 0).when(v > 0, power).otherwise(-power)


def _histogram(df: DataFrame, parts: Sequence[tuple[Column, Column, Column]]) -> dict[int, list[tuple]]:
    """Per part (value, whether it counts, range) the ranges in order: ``count, min, max``.

    Values that do not count get no range: their place may not fit an int.
    """
    cells = [
        F.struct(F.lit(i).alias("part"), F.when(counts, value).alias("v"), F.when(counts, at).cast("int").alias("at"))
        for i, (value, counts, at) in enumerate(parts)
    ]
    rows = df.select(F.inline(F.array(*cells))).filter(F.col("v").isNotNull())
    found = rows.groupBy("part", "at").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    out: dict[int, list[tuple]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["part"], r["at"])):
        out.setdefault(r["part"], []).append((r["n"], r["low"], r["high"]))
    return out


def _narrow(open_: Open, ranges: Sequence[tuple], known: dict[int, float]) -> list[Open]:
    """Ranks that are a range's ends are known; the others stay open in their range."""
    left, before = [], 0
    waiting = dict(open_.ranks)
    for n, low, high in ranges:
        inside = {}
        for rank, at in list(waiting.items()):
            if at >= before + n:
                continue
            del waiting[rank]
            if at == before or low == high or math.isnan(high):
                known[rank] = low
            elif at == before + n - 1:
                known[rank] = high
            else:
                inside[rank] = at - before
        if inside:
            left.append(Open(open_.column, low, high, inside))
        before += n
    return left


def values_at(df: DataFrame, ranks_of) -> dict[str, tuple[int, dict[int, float]]]:
    """The number of values of each column, and its values at the ranks (from 0) that it wants.

    ``ranks_of`` maps columns to a function from the number of values to ranks. NULLs are not
    counted, NaN is larger than any number and -0 equals 0, as elsewhere in Spark. ``df`` is
    read once a pass: stage it if its plan is dear.
    """
    columns = list(ranks_of)
    value = {c: F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in columns}
    counted = _histogram(df, [(value[c], F.lit(True), _power_range(value[c])) for c in columns])
    sizes, known, todo = {}, {c: {} for c in columns}, []
    for i, c in enumerate(columns):
        ranges = counted.get(i, [])
        sizes[c] = sum(n for n, _, _ in ranges)
        wanted = {r: r for r in ranks_of[c](sizes[c])} if sizes[c] else {}
        todo += _narrow(Open(c, 0.0, 0.0, wanted), ranges, known[c])
    while todo:
        parts = []
        for o in todo:
            v, low, high = value[o.column], F.lit(o.low), F.lit(o.high)
            parts.append((v, (v >= low) & (v <= high), F.floor((v - low) / (high - low) * RANGES)))
        counted = _histogram(df, parts)
        todo = [rest for i, o in enumerate(todo) for rest in _narrow(o, counted[i], known[o.column])]
    return {c: (sizes[c], known[c]) for c in columns}


def exact_quantiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``share`` and one double per column, interpolated between neighbours as ``percentile`` does.

    A column without values has NULLs. Equal to ``percentile`` for any number of distinct
    values, none of which are gathered in one place.
    """
    shares = [float(s) for s in shares]
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError(f"shares must lie between 0 and 1: {shares}")

    def ranks(n: int) -> set[int]:
        return {r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}

    found = values_at(df, {c: ranks for c in cols})
    rows = []
    for s in shares:
        row = [s]
        for c in cols:
            n, values = found[c]
            if not n:
                row.append(None)
                continue
            at = s * (n - 1)
            a, b = values[math.floor(at)], values[math.ceil(at)]
            row.append(a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
        rows.append(tuple(row))
    return df.sparkSession.createDataFrame(rows, ", ".join(["share double", *[f"`{c}` double" for c in cols]]))


def exact_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with each column's exact median; fits ``impute.fill_from`` for tables of any size."""
    return exact_quantiles(df, cols, [0.5]).drop("share")
