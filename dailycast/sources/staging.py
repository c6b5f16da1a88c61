"""Shared staging area: cut a plan by writing it once and reading it back.

Written tables survive the loss of executors, keep column pruning and carry
real sizes, so that later joins are planned from statistics.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The folder of this application below the one that ``spark.checkpoint.dir`` names.

    A folder given by ``setCheckpointDir`` does as well. Every machine must see it: a plain
    path without a scheme is taken to be on the default file system. Without a folder this
    fails, since none that is local to a machine would do.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    root = root or sc.getCheckpointDir()
    if not root:
        raise ValueError(
            "set spark.checkpoint.dir when the session is built, or call setCheckpointDir, "
            "with a folder that all executors share"
        )
    return f"{root.rstrip('/')}/dailycast/{sc.applicationId}"


def clear_staging(spark: SparkSession) -> None:
    """Remove what this application has staged; tables read from there are gone as well."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the staging area and return a scan of it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    out = df.coalesce(partitions) if partitions else df
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_together(spark: SparkSession, tasks: Iterable[Callable], workers: int = 4) -> list:
    """Run independent driver-side steps at once, so that their jobs share the cluster.

    Results come back in order. ``workers`` bounds how many jobs compete.
    """
    pinned = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return [f.result() for f in [pool.submit(pinned(t)) for t in tasks]]
