"""Normalised, combined and ranked feature scores, and fixed-size samples.

Score tables are long: ``source, feature, score``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dailycast.functions.numeric import row_mean

NATIVE = ("rf", "lgb", "xgb")
ATTRIBUTED = ("rf_shap", "lgb_shap", "xgb_shap")


def average_targets(scores: DataFrame) -> DataFrame:
    """Mean over the targets of ``source, feature, target, score``."""
    return scores.groupBy("source", "feature").agg(F.avg("score").alias("score"))


def normalize(scores: DataFrame) -> DataFrame:
    """Scores as shares of their source; left alone where the total is not positive."""
    total = F.sum("score").over(Window.partitionBy("source"))
    share = F.when(total > 0, F.try_divide("score", total)).otherwise(F.col("score"))
    return scores.withColumn("score", share)


def combine(scores: DataFrame, native=NATIVE, attributed=ATTRIBUTED) -> DataFrame:
    """One row per feature with its normalised scores and their means."""
    wide = scores.groupBy("feature").agg(
        *[
            F.max(F.when(F.col("source") == s, F.col("score"))).alias(s)
            for pair in zip(native, attributed)
            for s in pair
        ]
    )
    return wide.withColumns(
        {"native_mean": row_mean(*native), "shap_mean": row_mean(*attributed)}
    ).withColumn("overall_mean", (F.col("native_mean") + F.col("shap_mean")) / 2)


def ranked(df: DataFrame, by: str, tie: str = "feature") -> DataFrame:
    """Descending order with the name as tie-break."""
    return df.orderBy(F.desc(by), F.asc(tie))


def top_k(df: DataFrame, by: str, k: int, tie: str = "feature") -> DataFrame:
    return ranked(df, by, tie).limit(k)


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, repeatable by seed.

    Rows are ordered by a keyed hash, so the draw is a distributed top-n and does
    not depend on how the rows are partitioned.
    """
    mark = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    return df.orderBy(mark, *key).limit(n)
