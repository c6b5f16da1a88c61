"""Tables of predictions and the scores taken from them.

A prediction table is long: ``date, model, target, pred`` and, where the truth
is known, ``actual``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.functions.metrics import score

TARGETS = ("revenue", "cogs")


def melt_predictions(
    df: DataFrame, models: dict[str, tuple[str, str]], keys: Sequence[str] = ()
) -> DataFrame:
    """Wide to long: ``models`` maps a name to its revenue and cogs columns."""
    has_actual = all(t in df.columns for t in TARGETS)
    cells = []
    for name, columns in models.items():
        for target, column in zip(TARGETS, columns):
            fields = [
                F.lit(name).alias("model"),
                F.lit(target).alias("target"),
                F.col(column).cast("double").alias("pred"),
            ]
            if has_actual:
                fields.append(F.col(target).alias("actual"))
            cells.append(F.struct(*fields))
    return df.select(*keys, "date", F.explode(F.array(*cells)).alias("_p")).select(
        *keys, "date", "_p.*"
    )


def fill_head(oof: DataFrame, value: float | None = 0.0) -> DataFrame:
    """Rows no fold validates: predicted as ``value``, or left out when ``None``."""
    if value is None:
        return oof.filter(F.col("fold") > 0)
    return oof.withColumn(
        "pred", F.when(F.col("fold") > 0, F.col("pred")).otherwise(F.lit(float(value)))
    )


def fold_scores(preds: DataFrame) -> DataFrame:
    """Scores by fold, model and target for rows already tagged with a fold."""
    return score(preds, ["fold", "model", "target"])


def oof_scores(preds: DataFrame) -> DataFrame:
    return score(preds, ["model", "target"])


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation over the folds, with a display label."""
    return (
        scores.groupBy("model", "target")
        .agg(
            F.avg("mape").alias("mape_mean"),
            F.stddev_samp("mape").alias("mape_std"),
            F.avg("r2").alias("r2_mean"),
            F.stddev_samp("r2").alias("r2_std"),
        )
        .withColumn("model_target", F.concat_ws("_", "model", "target"))
    )


def average_folds(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One prediction per row and model: the mean over the fold models."""
    return preds.groupBy(*keys, "date", "model", "target").agg(F.avg("pred").alias("pred"))


def stack_matrix(
    preds: DataFrame, models: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """One row per date and target, one column per model.

    The model names are given, so no extra job has to find them, and the pivot
    is a single aggregation.
    """
    return preds.groupBy(*keys, "date", "target").agg(
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models]
    )
