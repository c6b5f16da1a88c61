"""What a long run has finished, kept in a shared folder so that the next run goes on from there.

An entry is a small folder of JSON or a table in Parquet. It counts from the moment Spark's
commit has marked it complete; what a killed run left half written is written anew.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Entries of one run below ``folder``, which every machine must see and nobody clears."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def place(self, name: str) -> str:
        """A fresh path for files that an entry will point to."""
        return f"{self.folder}/files/{name}-{uuid.uuid4().hex}"

    def _at(self, name: str) -> str:
        return f"{self.folder}/entries/{name}"

    def has(self, name: str) -> bool:
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(name)}/_SUCCESS")
        return marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marker)

    def record(self, name: str, entry: dict) -> dict:
        rows = self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1)
        rows.write.mode("overwrite").text(self._at(name))
        return entry

    def recall(self, name: str) -> dict | None:
        if not self.has(name):
            return None
        return json.loads(self.spark.read.text(self._at(name), wholetext=True).first()["value"])

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._at(name))
        return self.spark.read.schema(df.schema).parquet(self._at(name))

    def kept(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self._at(name)) if self.has(name) else None

    def belongs_to(self, name: str, entry: dict) -> None:
        """Fix what the run is about; a folder begun for something else is refused."""
        begun = self.recall(name)
        if begun is None:
            self.record(name, entry)
        elif begun != json.loads(json.dumps(entry)):
            raise ValueError(f"{self.folder} holds another run: {begun}, not {entry}")


def fingerprint(df: DataFrame) -> dict:
    """Row count and a sum of row hashes, whatever the order and partitioning of the rows."""
    parts = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    mark = F.sum(parts[0].cast("decimal(38,0)")).cast("string")
    found = df.agg(F.count("*").alias("rows"), mark.alias("mark")).first()
    return {"rows": found["rows"], "mark": found["mark"]}
