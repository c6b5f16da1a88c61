"""Stacking base predictions, the residual layer, and the choice between variants.

The stack matrix is long in targets: ``date, target, <one column per model>`` and,
on the training side, ``actual``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.functions.metrics import mape, r2
from dailycast.functions.numeric import cap_to_margin, clipped_expm1, floor_zero, log_target, round_cents
from dailycast.operators.linear import META, MetaFit, MetaSpec, fit_meta, from_moments, moments_by, solve, weight_rows
from dailycast.operators.scoring import TARGETS
from dailycast.sources.staging import run_together

# The residual layer's penalties per target.
RESIDUAL = {
    "revenue": MetaSpec("residual", "penalty", alpha=0.1, l1_share=0.5, scaled=True),
    "cogs": MetaSpec("residual", "penalty", alpha=0.001, l1_share=0.8, scaled=True),
}


def of_target(matrix: DataFrame, target: str) -> DataFrame:
    return matrix.filter(F.col("target") == target)


def fit_stack(
    matrix: DataFrame, models: Sequence[str], spec: MetaSpec
) -> dict[str, MetaFit]:
    """One meta-learner per target, fitted on raw (not log) amounts."""
    return fit_stacks(matrix, models, [spec])[0]


def fit_stacks(matrix: DataFrame, models: Sequence[str], specs: Sequence[MetaSpec]) -> list[dict[str, MetaFit]]:
    """Several meta-learners; one scan serves both targets of all that moments determine."""
    return _fit_targets(matrix, models, "actual", [{t: s for t in TARGETS} for s in specs])


def _fit_targets(rows: DataFrame, columns, label: str, wanted: Sequence[dict[str, MetaSpec]]) -> list[dict[str, MetaFit]]:
    """The fits are independent, so what needs a job of its own runs at the same time."""
    some = any(from_moments(s) for specs in wanted for s in specs.values())
    jobs = [lambda: moments_by(rows, columns, label, "target") if some else {}]
    single = [(i, t, s) for i, specs in enumerate(wanted) for t, s in specs.items() if not from_moments(s)]
    jobs += [lambda t=t, s=s: fit_meta(of_target(rows, t), columns, label, s) for _, t, s in single]
    known, *fits = run_together(rows.sparkSession, jobs)
    fitted = {(i, t): f for (i, t, _), f in zip(single, fits)}
    return [
        {t: fitted[i, t] if (i, t) in fitted else solve(known[t], columns, s) for t, s in specs.items()}
        for i, specs in enumerate(wanted)
    ]


def predict_stack(
    matrix: DataFrame, fits: dict[str, MetaFit], keys: Sequence[str] = ()
) -> DataFrame:
    """``date, target, pred`` (and ``actual`` if present), neither floored nor capped."""
    keep = [*keys, "date", "target", *[c for c in ("actual",) if c in matrix.columns]]
    parts = [f.predict(of_target(matrix, t), "pred").select(*keep, "pred") for t, f in fits.items()]
    return parts[0].unionByName(parts[1])


def to_wide(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``date, revenue, cogs`` from one prediction per target."""
    return preds.groupBy(*keys, "date").agg(
        *[F.max(F.when(F.col("target") == t, F.col("pred"))).alias(t) for t in TARGETS]
    )


def constrain(wide: DataFrame) -> DataFrame:
    """Floor at zero and hold cost below its share of revenue."""
    return wide.withColumns(
        {"cogs": cap_to_margin("cogs", "revenue"), "revenue": floor_zero("revenue")}
    )


def format_forecast(wide: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``Date, Revenue, COGS`` as text and amounts rounded to cents, halves to even."""
    return wide.select(
        *keys,
        F.date_format("date", "yyyy-MM-dd").alias("Date"),
        round_cents("revenue").alias("Revenue"),
        round_cents("cogs").alias("COGS"),
    )


def stack_weights(fits: dict[str, MetaFit], spark) -> DataFrame:
    rows = [r for t, f in fits.items() for r in weight_rows(f, t)]
    return spark.createDataFrame(rows, "meta_learner string, target string, model string, weight double")


def fit_residual(
    stacked: DataFrame, features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()
) -> dict[str, MetaFit]:
    """Linear model of what the stack leaves over, on the log scale.

    ``stacked`` is the training-side output of ``predict_stack``.
    """
    gap = log_target("actual") - log_target(floor_zero("pred"))
    rows = stacked.withColumn("_gap", gap).join(features, [*keys, "date"])
    return _fit_targets(rows, columns, "_gap", [RESIDUAL])[0]


def predict_residual(
    stacked: DataFrame, features: DataFrame, fits: dict[str, MetaFit], keys: Sequence[str] = ()
) -> DataFrame:
    """Stack output moved by the predicted log residual, floored at zero."""
    rows = stacked.join(features, [*keys, "date"])
    keep = [*keys, "date", "target", *[c for c in ("actual",) if c in stacked.columns]]
    parts = []
    for t, f in fits.items():
        moved = log_target(floor_zero("pred")) + f.column()
        parts.append(
            of_target(rows, t).select(*keep, floor_zero(clipped_expm1(moved)).alias("pred"))
        )
    return parts[0].unionByName(parts[1])


def score_rows(preds: DataFrame) -> DataFrame:
    """One row with both targets' scores, from long predictions with actuals."""
    by_target = preds.groupBy("target").agg(mape().alias("mape"), r2().alias("r2"))
    cells = [
        F.max(F.when(F.col("target") == t, F.col(m))).alias(f"{m}_{t}")
        for m in ("mape", "r2")
        for t in TARGETS
    ]
    return by_target.agg(*cells)


def compare_stackers(
    matrix: DataFrame, models: Sequence[str], keys: Sequence[str] = (), specs=None
) -> DataFrame:
    """Every meta-learner scored on the rows it was fitted on, best first.

    Predictions are floored and capped before scoring. ``ordinal`` keeps the
    comparison order, which decides between equal scores.
    """
    actual = matrix.select(*keys, "date", "target", "actual")
    boards, specs = [], list(specs or META.values())
    for i, (spec, fits) in enumerate(zip(specs, fit_stacks(matrix, models, specs))):
        wide = constrain(to_wide(predict_stack(matrix, fits, keys), keys))
        long = wide.select(
            *keys,
            "date",
            F.explode(
                F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("pred")) for t in TARGETS])
            ).alias("_p"),
        ).select(*keys, "date", "_p.*")
        scored = score_rows(long.join(actual, [*keys, "date", "target"]))
        boards.append(
            scored.select(
                F.lit(spec.name).alias("meta_learner"),
                "mape_revenue",
                "mape_cogs",
                ((F.col("mape_revenue") + F.col("mape_cogs")) / 2).alias("avg_mape"),
                "r2_revenue",
                "r2_cogs",
                F.lit(i).alias("ordinal"),
            )
        )
    out = boards[0]
    for b in boards[1:]:
        out = out.unionByName(b)
    return out.orderBy("avg_mape", "ordinal")


def best_stacker(board: DataFrame) -> DataFrame:
    """The first meta-learner, in comparison order, with the lowest average MAPE."""
    best = F.min_by(F.struct("meta_learner", "avg_mape"), F.struct("avg_mape", "ordinal"))
    return board.agg(best.alias("b")).select("b.meta_learner", "b.avg_mape")


def pick_variant(scores: DataFrame, variants: Sequence[str]) -> DataFrame:
    """The variant with the lowest MAPE summed over targets; ties go to the earlier one."""
    order = F.array_position(F.array(*[F.lit(v) for v in variants]), F.col("variant"))
    totals = (
        scores.filter(F.col("variant").isin(list(variants)))
        .groupBy("variant")
        .agg(F.sum("mape").alias("total_mape"))
    )
    best = F.min_by(F.struct("variant", "total_mape"), F.struct("total_mape", order))
    return totals.agg(best.alias("b")).select("b.variant", "b.total_mape")
