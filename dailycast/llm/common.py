"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, wish: str) -> str:
    """``wish``, or ``wish`` with underscores where the table already has such a column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def batch_texts(column) -> list:
    """UTF-8 bytes of an Arrow string column; null counts as the empty text."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(columns, rows: int = 256):
    """The values of Arrow columns, a few rows at a time: only these are Python objects at once."""
    for column in columns:
        for i in range(0, len(column), rows):
            yield column.slice(i, rows).to_pylist()


_WORKER: dict = {}


def held(key: tuple, make):
    """What a Python worker keeps from task to task; things of another first key part are let go."""
    if key not in _WORKER:
        for other in [k for k in _WORKER if k[0] != key[0]]:
            del _WORKER[other]
        _WORKER[key] = make()
    return _WORKER[key]
