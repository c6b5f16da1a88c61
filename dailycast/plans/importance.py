"""Feature importance from models fitted on the whole history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.operators import attribution, ranking, trees
from dailycast.sources.ledger import Ledger, fingerprint
from dailycast.sources.staging import run_together, stage

TARGETS = ("revenue", "cogs")


@dataclass(frozen=True)
class ImportanceConfig:
    """The three models without early stopping; the defaults are the full-size ones."""

    forest: trees.TreeSpec = trees.FOREST
    deep: trees.TreeSpec = replace(trees.DEEP, max_rounds=500, patience=None)
    shallow: trees.TreeSpec = replace(trees.SHALLOW, max_rounds=500, patience=None)
    workers: int = 8

    @property
    def specs(self) -> tuple[trees.TreeSpec, ...]:
        return (self.forest, self.deep, self.shallow)


def small_config(rounds: int = 8, trees_per_forest: int = 20) -> ImportanceConfig:
    """The same steps with few trees, for trial runs."""
    return ImportanceConfig(
        forest=replace(trees.FOREST, max_rounds=trees_per_forest, depth=5),
        deep=replace(trees.DEEP, max_rounds=rounds, patience=None, step=0.3, depth=4),
        shallow=replace(trees.SHALLOW, max_rounds=rounds, patience=None, step=0.3, depth=3),
    )


def native_scores(spark, model, nodes: DataFrame, spec: trees.TreeSpec, columns: Sequence[str]):
    """Impurity decrease of a forest, total gain of deep and mean gain of shallow boosting."""
    if spec.kind == "forest":
        return trees.impurity_importance(spark, model, columns)
    how = "sum" if spec.name == trees.DEEP.name else "avg"
    return trees.gain_importance(spark, nodes, columns, how)


def model_scores(
    rows: DataFrame, columns: Sequence[str], config: ImportanceConfig, folder: str | None = None
) -> DataFrame:
    """``source, feature, target, score`` for every model, target and kind of score.

    With a shared ``folder`` the scores of every finished model are kept there, and a later run
    over the same rows with the same settings fits only the others.
    """
    spark = rows.sparkSession
    columns = list(columns)
    ledger = Ledger(spark, folder) if folder else None
    if ledger:
        settings = {k: v for k, v in asdict(config).items() if k != "workers"}
        labels = [f"log_{t}" for t in TARGETS]
        ledger.belongs_to("run", {"settings": settings, "columns": columns, **fingerprint(rows.select("date", *labels, *columns))})

    def one(spec: trees.TreeSpec, target: str) -> list[DataFrame]:
        name = f"scores_{spec.name}_{target}"
        if not ledger:
            return scored(spec, target)
        done = ledger.kept(name)
        if done is None:
            native, shap = scored(spec, target)
            done = ledger.keep(name, native.unionByName(shap).coalesce(1))  # two rows a feature
        return [done]

    def scored(spec: trees.TreeSpec, target: str) -> list[DataFrame]:
        model = trees.fit(rows, f"log_{target}", spec)
        nodes = trees.node_table(spark, model)
        ensemble = trees.load_ensemble(nodes)
        shap = attribution.mean_abs(
            attribution.attribute(rows.select("date", "features"), ensemble, len(columns)), columns
        )
        native = native_scores(spark, model, nodes, spec, columns)
        return [
            s.select(F.lit(source).alias("source"), "feature", F.lit(target).alias("target"), "score")
            for source, s in ((spec.name, native), (f"{spec.name}_shap", shap))
        ]

    cells = [(s, t) for s in config.specs for t in TARGETS]
    parts = [p for ps in run_together(spark, [lambda c=c: one(*c) for c in cells], config.workers) for p in ps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stage(out, "importance", partitions=1)  # models x targets x features rows


def run_importance(
    rows: DataFrame, columns: Sequence[str], config: ImportanceConfig = ImportanceConfig(), folder: str | None = None
) -> DataFrame:
    """Ranked table of every feature's normalised scores and their means; see ``model_scores`` for ``folder``."""
    scores = ranking.average_targets(model_scores(rows, columns, config, folder))
    return ranking.ranked(ranking.combine(ranking.normalize(scores)), "overall_mean")
