"""The corpus pipeline: stages in order, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.llm import decontaminate, line_runs, passage_quality, pivot_simhash
from dailycast.llm.catalog import fold, known_labels, packed
from dailycast.llm.common import spare_name, table
from dailycast.sources.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1 stay."""
    out = spare_name(docs, "__quality")
    labels = known_labels(spark, sf_dir, "quality", fold(3) != 1)
    return passage_quality.score_quality(docs, labels, out=out).filter(F.col(out) >= 0.5).drop(out)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; texts and their sizes follow."""
    out = spare_name(docs, "__lines")
    done = line_runs.drop_common_lines(docs, out=out)
    done = done.withColumn("text", F.col(out)["kept"])
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).drop(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    return pivot_simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into sequences."""
    return packed(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
