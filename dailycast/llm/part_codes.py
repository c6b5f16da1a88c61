"""Vector compression: product-quantized codes from Lloyd rounds whose members stay where they live.

Each vector is cut into parts; the parts at one position share a codebook. A part is a member of
the codebook entry that it is assigned to, and members are partitioned by (position, entry,
salt), with salts enough that no group outgrows a share of a partition. In a round the owners
reassign their resident members and write them down where they are; the next read takes
members that kept their entry as they lie, and only those that changed it go through a shuffle
to their new owner. Owners then update entries from the members they hold: sums and counts per
group, added up over salts.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm.common import spare_name
from dailycast.sources.staging import stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Least members of a salted group.
GROUP = 512

_MEMBER = "row long, position int, part array<long>, home int, entry int, error long"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(part: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, ties to the lower one, and its squared distance."""
    best, error = np.zeros(len(part), np.int32), np.full(len(part), np.iinfo(np.int64).max)
    for k, entry in enumerate(codebook):
        far = ((part - entry) ** 2).sum(axis=1)
        near = far < error
        best[near], error[near] = k, far[near]
    return best, error


def assign(members: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Members with the entry nearest to each, where they lie; ``home`` keeps the one that they came with.

    ``codebooks`` (position, entry, component) goes along with the task: its size is fixed.
    """
    schema = pa.schema(
        [("row", pa.int64()), ("position", pa.int32()), ("part", pa.list_(pa.int64())), ("home", pa.int32()),
         ("entry", pa.int32()), ("error", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch["position"].to_numpy()
            part = _matrix(batch["part"]) if len(batch) else np.zeros((0, codebooks.shape[2]), np.int64)
            entry, error = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            for p in np.unique(position):
                mine = position == p
                entry[mine], error[mine] = _nearest(part[mine], codebooks[p])
            columns = [batch["row"], batch["position"], batch["part"], batch["entry"], pa.array(entry), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return members.select("row", "position", "part", "entry").mapInArrow(run, _MEMBER)


def group_sizes(members: DataFrame) -> dict[tuple[int, int], int]:
    """How many members each (position, entry) has; a row for each entry at most."""
    return {(r["position"], r["entry"]): r["n"] for r in members.groupBy("position", "entry").agg(F.count("*").alias("n")).collect()}


def settle(moving: DataFrame, sizes: dict[tuple[int, int], int], partitions: int) -> DataFrame:
    """``moving`` members partitioned by (position, entry, salt); an entry has salts by its size.

    A group holds a quarter of a partition's even share or ``GROUP``, so that neither an entry
    with most of the rows nor many groups that meet in one partition make a task long.
    """
    spark = moving.sparkSession
    share = max(GROUP, sum(sizes.values()) // (4 * partitions))
    salts = spark.createDataFrame([(p, e, -(-n // share)) for (p, e), n in sizes.items()], "position int, entry int, salts int")
    salted = moving.join(F.broadcast(salts), ["position", "entry"])
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    dealt = salted.repartition(partitions, "position", "entry", "salt")
    return dealt.sortWithinPartitions("position", "entry", "salt").select("row", "position", "part", "home", "entry", "error")


def residents(written: DataFrame, sizes: dict[tuple[int, int], int], partitions: int) -> DataFrame:
    """Members that kept their entry, where they lie, and those that changed it, at their new owner's."""
    stay = written.filter(F.col("home") == F.col("entry"))
    return stay.unionByName(settle(written.filter(F.col("home") != F.col("entry")), sizes, partitions))


def update(members: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Entries moved to the floor of their members' mean; those without members stay.

    Each owner sums its residents, one row a group and batch; sums of owners are added exactly.
    """
    width = codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(codebooks.shape[:2], np.int64)
        total = np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            at = batch["position"].to_numpy(), batch["entry"].to_numpy()
            np.add.at(n, at, 1)
            np.add.at(total, at, _matrix(batch["part"]))
        p, e = np.nonzero(n)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e])]
        columns += [pa.array(total[p, e, i]) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "n", *(f"s{i}" for i in range(width))])

    schema = "position int, entry int, n long," + ",".join(f"s{i} long" for i in range(width))
    sums = members.select("position", "part", "entry").mapInArrow(run, schema).groupBy("position", "entry")
    sums = sums.agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
    out = codebooks.copy()
    for r in sums.collect():  # at most one row for each entry
        out[r["position"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def codebooks_text(codebooks: np.ndarray) -> str:
    return ",".join(map(str, codebooks.ravel().tolist()))


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    out: str = "code",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` without ``embedding``, with a struct ``out``, and the final codebooks.

    ``out`` holds ``entries`` (the entry of each part, in order), ``error`` (squared distances of
    whole-number components, summed over parts) and ``label_error`` (the errors of all rows with
    the same label, nulls together). A component x counts as floor(scale * x). Codebooks begin as
    the parts of the ``entries`` least ids, ties by the vector, null ids last; with fewer rows
    they have fewer entries. Rows whose vector is null or has null or non-finite components are
    dropped; every other row has a result of its own, repeated ones and null ids too. Other columns
    pass through; one named ``out`` is replaced. An empty table gives an empty one. Vectors of
    different lengths, lengths that ``parts`` does not divide, and components so large that an
    error might not fit a long are a ValueError.
    """
    spark = vectors.sparkSession
    row, whole, codes, error = (spare_name(vectors, f"__{n}") for n in ("row", "whole", "codes", "error"))
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.filter(F.col(embedding).isNotNull() & fine).drop(out)
    columns = [c for c in kept.columns if c != embedding]
    kept = kept.withColumn(whole, v).drop(embedding)
    kept = stage(kept.withColumn(row, F.monotonically_increasing_id()), "vectors")
    size, large = F.size(whole), F.aggregate(whole, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    told = kept.agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.max(large).alias("large")).first()
    if not told["n"]:
        kind = "struct<entries:array<int>,error:long,label_error:long>"
        return kept.select(*columns, F.lit(None).cast(kind).alias(out)), np.zeros((parts, 0, 0), np.int64)
    width, rest = divmod(told["most"], parts)
    if told["least"] != told["most"] or rest or not width:
        raise ValueError(f"vectors must have one length that {parts} divides")
    if told["most"] * (2 * scale * told["large"] + 2) ** 2 >= 2**63:
        raise ValueError("components are so large that an error may not fit a long")

    number = F.transform(whole, lambda x: F.floor(x * scale).cast("long"))
    first = kept.select(number.alias("whole"), F.col(vec_id).alias("id")).orderBy(F.col("id").asc_nulls_last(), "whole").limit(entries)
    first = np.array([r["whole"] for r in first.collect()], np.int64)
    codebooks = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()

    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("whole", p * width + 1, width))
    members = (
        kept.select(F.col(row).alias("row"), number.alias("whole"))
        .select("row", F.posexplode(cut).alias("position", "part"))
        .withColumn("entry", F.lit(-1))
    )
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), members.rdd.getNumPartitions())
    written = stage(assign(members, codebooks), "members")
    for k in range(rounds):
        here = residents(written, group_sizes(written), partitions)
        if not k:  # all rows move once
            here = stage(here, "members")
        codebooks = update(here, codebooks)
        written = stage(assign(here, codebooks), "members")

    coded = written.groupBy(F.col("row").alias(row)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"]).alias(codes),
        F.sum("error").alias(error),
    )
    coded = stage(kept.drop(whole).join(coded, row), "coded")
    return _with_labels(coded, columns, label, codes, error, out), codebooks


def _with_labels(coded: DataFrame, columns: list[str], label: str, codes: str, error: str, out: str) -> DataFrame:
    """The rows' results beside the sum of errors of their label; a label that most rows share is summed before it moves."""
    key, total = spare_name(coded, "__label"), spare_name(coded, "__total")
    sums = coded.groupBy(F.col(label).alias(key)).agg(F.sum(error).alias(total))
    joined = coded.join(sums, F.col(label).eqNullSafe(F.col(key)))
    result = F.struct(F.col(codes).alias("entries"), F.col(error).alias("error"), F.col(total).alias("label_error"))
    return joined.select(*columns, result.alias(out))


def codebooks_sha256(codebooks: np.ndarray) -> str:
    """Digest of all entries' components by part, entry and place, in decimal."""
    return hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
