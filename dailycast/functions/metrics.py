"""Forecast scores as aggregate expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailycast.functions.numeric import is_finite

# Fixed values of the score definitions.
MAPE_EPS = 1e-9
FLAT_TARGET = 1e-12


def finite_pairs(df: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    return df.filter(is_finite(actual) & is_finite(pred))


def ape(actual: str = "actual", pred: str = "pred") -> Column:
    """Absolute percentage error of one row; NULL unless both sides are finite."""
    a, p = F.col(actual), F.col(pred)
    return F.when(
        is_finite(a) & is_finite(p), F.abs(a - p) / (F.abs(a) + F.lit(MAPE_EPS))
    )


def mape(actual: str = "actual", pred: str = "pred") -> Column:
    """Mean absolute percentage error; +inf when no pair is finite."""
    return F.coalesce(F.avg(ape(actual, pred)), F.lit(math.inf))


def r2(actual: str = "actual", pred: str = "pred") -> Column:
    """Coefficient of determination as one aggregate, so scoring is one pass.

    ``var_pop`` merges centred partial moments, which avoids both a second
    scan for the mean and the cancellation of a raw sum of squares.
    """
    a, p = F.col(actual), F.col(pred)
    ok = is_finite(a) & is_finite(p)
    n = F.count(F.when(ok, a))
    ss_res = F.sum(F.when(ok, (a - p) * (a - p)))
    ss_tot = F.var_pop(F.when(ok, a)) * n
    return (
        F.when(n == 0, F.lit(0.0))
        .when(
            ss_tot < FLAT_TARGET,
            F.when(ss_res < FLAT_TARGET, F.lit(1.0)).otherwise(F.lit(0.0)),
        )
        .otherwise(F.lit(1.0) - F.try_divide(ss_res, ss_tot))
    )


def score(
    df: DataFrame, by: Sequence[str] = (), actual: str = "actual", pred: str = "pred"
) -> DataFrame:
    """MAPE and R2 for every group, both from the same aggregation."""
    return df.groupBy(*by).agg(
        mape(actual, pred).alias("mape"), r2(actual, pred).alias("r2")
    )
