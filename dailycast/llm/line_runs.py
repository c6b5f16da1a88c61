"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (line hash, number of documents), bucketed and sorted by hash, in the
shared folder. Each new batch is counted, merge-anti-joined with the keys that the runs
have closed (that reached the limit already), and written as a run of its own; runs of one
level are compacted into one of the next. Runs meet on their buckets, so neither joining
nor compacting them shuffles a run again.
"""

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailycast.llm.common import batch_texts, spare_name
from dailycast.sources.staging import stage, stage_path

KEYS = "array<struct<h1:long,h2:long>>"
_PAIR = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])

#: Beyond so many common lines they are joined with the documents instead of broadcast.
BROADCAST_KEYS = 200_000

_BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def _digests(text: bytes, min_chars: int) -> list:
    """A 16-byte hash for each line's key; None where the key is too short to be dropped."""
    out = []
    for line in text.split(b"\n"):
        key = line_key(line)
        short = not key if min_chars == 1 else len(key.decode("utf-8", "replace")) < min_chars
        out.append(None if short and min_chars > 0 else xxhash.xxh3_128_digest(key))
    return out


def _pairs(groups: list[list[bytes]]) -> pa.ListArray:
    flat = np.frombuffer(b"".join(map(b"".join, groups)), "<i8").reshape(-1, 2)
    ends = np.cumsum([0, *map(len, groups)]).astype(np.int32)
    values = pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(flat[:, 0])), pa.array(np.ascontiguousarray(flat[:, 1]))],
        fields=list(_PAIR),
    )
    return pa.ListArray.from_arrays(pa.array(ends), values)


def document_keys(text, min_chars: int = 1):
    """The distinct line hashes of each text, an array column."""

    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _pairs([[k for k in dict.fromkeys(_digests(t, min_chars)) if k] for t in batch_texts(batch)])

    return F.arrow_udf(keys, KEYS)(text)


class LineRuns:
    """Levelled runs of line hashes with the number of documents that hold each."""

    def __init__(self, spark: SparkSession, limit: int, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.limit, self.fan_in = spark, limit, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option(
            "path", stage_path(self.spark, name)
        ).saveAsTable(name)
        return name

    def _spread(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "h1", "h2")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Count a batch of (h1, h2), a row for each document with the line, as a new run."""
        rows = batch.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
        for run in self.runs():
            rows = rows.join(run.filter(F.col("n_docs") >= self.limit), ["h1", "h2"], "left_anti")
        self._push(0, self._write(self._spread(rows)))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan_in:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, merged)

    def _merge(self, names: list[str]) -> str:
        merged = self._write(self._spread(self._total(names)))
        for name in names:
            self.spark.sql(f"drop table {name}")
        return merged

    def _total(self, names: list[str]) -> DataFrame:
        rows = self.spark.table(names[0])
        for name in names[1:]:
            rows = rows.unionByName(self.spark.table(name))
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def common(self) -> DataFrame:
        """The keys that at least ``limit`` documents hold."""
        names = [name for level in self.levels for name in level]
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._total(names).filter(F.col("n_docs") >= self.limit).select("h1", "h2")


_KEPT = "struct<kept:string,n_lines:long,n_dropped:long>"
_KEPT_TYPE = pa.struct([("kept", pa.large_string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def _without(texts: list[bytes], gone, min_chars: int) -> pa.StructArray:
    """``kept`` is null where nothing is dropped: the text need not travel back."""
    kept, lines, dropped = [], [], []
    for text, some in zip(texts, gone):
        body = text.split(b"\n")
        lost = [k in some for k in _digests(text, min_chars)] if some else []
        n = sum(lost)
        lines.append(len(body))
        dropped.append(n)
        kept.append(b"\n".join(x for x, y in zip(body, lost) if not y).decode() if n else None)
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.large_string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
        fields=list(_KEPT_TYPE),
    )


_WORKER: dict = {}


def drop_with_table(text, common: DataFrame, min_chars: int = 1):
    """Lines dropped on the map side; ``common`` is known to be small."""
    rows = common.toLocalIterator()
    raw = b"".join(np.array([r["h1"], r["h2"]], "<i8").tobytes() for r in rows)
    table, key = common.sparkSession.sparkContext.broadcast(raw), uuid.uuid4().hex

    def drop(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = {table.value[i : i + 16] for i in range(0, len(table.value), 16)}
        for batch in batches:
            yield _without(batch_texts(batch), repeat(_WORKER[key]), min_chars)

    return F.arrow_udf(drop, _KEPT)(text)


def drop_with_join(docs: DataFrame, text: str, common: DataFrame, min_chars: int, out: str) -> DataFrame:
    """Lines dropped by joins: texts meet their common lines on a hash of the text.

    Equal texts lose equal lines, so the key needs neither an id nor a stable order. Hot
    keys on either join are split by adaptive execution; the aggregate combines first.
    """
    t1, t2, gone = (spare_name(docs, n) for n in ("__t1", "__t2", "__gone"))
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(t1, F.xxhash64(body)).withColumn(t2, F.xxhash64(F.lit(1), F.reverse(body)))
    lines = keyed.select(t1, t2, F.explode(document_keys(F.col(text), min_chars)).alias("k"))
    lines = lines.select(t1, t2, "k.h1", "k.h2").join(common, ["h1", "h2"], "left_semi")
    hits = lines.groupBy(t1, t2).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))

    def drop(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, found in batches:
            sets = [
                {np.array([k["h1"], k["h2"]], "<i8").tobytes() for k in some or ()}
                for some in found.to_pylist()
            ]
            yield _without(batch_texts(batch), sets, min_chars)

    joined = keyed.join(hits, [t1, t2], "left")
    return joined.withColumn(out, F.arrow_udf(drop, _KEPT)(F.col(text), F.col(gone))).drop(t1, t2, gone)


def drop_common_lines(
    docs: DataFrame,
    text: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 4,
    out: str = "line_dedup",
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``docs`` with a struct ``out``: kept text, n_lines and n_dropped of each document.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at
    least ``min_chars`` code points that ``min_docs`` documents hold (repeats inside one
    document count once, repeated rows each) lose all their lines; the others stay in order.
    Null and empty texts are one empty line. An empty table gives an empty table. Columns
    pass through; one named ``out`` is replaced.
    """
    spark = docs.sparkSession
    batch = spare_name(docs, "__batch")
    keys = docs.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(batches)).alias(batch),
        F.explode(document_keys(F.col(text), min_chars)).alias("k"),
    ).select(batch, "k.h1", "k.h2")
    keys = stage(keys, "line_keys")
    store = LineRuns(spark, min_docs)
    for i in range(batches):
        store.add(keys.filter(F.col(batch) == i).select("h1", "h2"))
    common = stage(store.common(), "common_lines")
    if common.count() <= broadcast_keys:
        done = docs.withColumn(out, drop_with_table(F.col(text), common, min_chars))
    else:
        done = drop_with_join(docs, text, common, min_chars, out)
    result = F.col(out)
    return done.withColumn(
        out,
        F.struct(
            F.coalesce(result["kept"], F.col(text), F.lit("")).alias("kept"),
            result["n_lines"].alias("n_lines"),
            result["n_dropped"].alias("n_dropped"),
        ),
    )
