"""SimHash near-duplicates found with pivot distance tables.

Every distinct fingerprint gets its Hamming distances to reference fingerprints. A pair
within ``max_bits`` can differ by at most that much in any coordinate, which discards pairs
before their bits are compared. The references are laid out so that the table also says where
to look: those of one block of bits agree outside it, so the differences of their coordinates
depend on that block alone. At most ``max_bits`` differing bits leave all but ``max_bits``
blocks as they are, so any linked pair has equal coordinate differences in some choice of the
other blocks; these form cells, and only cells are searched. A cell with many fingerprints
is cut again by blocks of the bits still open until it is small by construction, so no group
of near copies, however large, meets in one task.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm.common import batch_texts, spare_name
from dailycast.llm.components import components
from dailycast.sources.staging import stage

SEED = 42
#: References that see one block of bits, and references that see all bits.
PER_BLOCK, GENERAL = 12, 32
#: Fingerprints in a cell beyond which it is cut again.
CELL = 512
#: Pairs whose coordinates are compared at once.
PAIRS = 200_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 where there are no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.array([digest(joined[a:z], SEED) for a, z in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65_536)):
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text, shingle: int = 3):
    """Fingerprints of a text column, as a signed long column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch_texts(batch)], np.uint64)
            yield pa.array(prints.view(np.int64))

    return F.arrow_udf(run, "long")(text)


class PivotTable:
    """Reference fingerprints, the distances of others to them, and the cells they give."""

    def __init__(self, max_bits: int):
        rng = np.random.default_rng(7)
        self.max_bits = max_bits
        self.base = rng.integers(0, 2**64, dtype=np.uint64)
        self.general = rng.integers(0, 2**64, GENERAL, dtype=np.uint64)
        self.choices = list(combinations(range(2 * max_bits), max_bits))

    @staticmethod
    def distances(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
        return np.bitwise_count(prints[:, None] ^ refs[None, :]).astype(np.int8)

    def block_code(self, prints: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The coordinate differences that depend on one block of bits, as one number.

        The block's references flip random bits of the common reference inside the block.
        """
        rng = np.random.default_rng(positions.tolist())
        flips = rng.integers(0, 2, (PER_BLOCK, len(positions)), dtype=np.uint64)
        weights = np.uint64(1) << positions.astype(np.uint64)
        refs = self.base ^ (flips * weights).sum(axis=1, dtype=np.uint64)
        table = self.distances(prints, refs) - self.distances(prints, self.base[None])
        code = np.zeros(len(prints), np.uint64)
        for column in table.T:
            code = _mix(code ^ column.astype(np.int64).view(np.uint64))
        return code

    def open_positions(self, path: list[int]) -> np.ndarray:
        """Bits that the cells of a path, one choice of blocks a level, leave open."""
        positions = np.arange(64)
        for c in path:
            blocks = np.array_split(positions, 2 * self.max_bits)
            kept = set(self.choices[c])
            positions = np.concatenate([b for k, b in enumerate(blocks) if k not in kept])
        return positions

    def cells(self, path: list[int], code: np.ndarray, prints: np.ndarray):
        """For each choice of blocks of the open bits: the longer path's last step and the codes."""
        blocks = np.array_split(self.open_positions(path), 2 * self.max_bits)
        codes = [self.block_code(prints, b) for b in blocks]
        for c, chosen in enumerate(self.choices):
            out = _mix(code + np.uint64(c + 1))
            for k in chosen:
                out = _mix(out ^ codes[k])
            yield c, out

    def levels(self) -> int:
        """Cuts after which a cell cannot hold more than ``CELL`` fingerprints."""
        path: list[int] = [0]
        while 2 ** len(self.open_positions(path)) > CELL:
            path.append(0)
        return len(path)

    def near_pairs(self, prints: np.ndarray, left: np.ndarray, right: np.ndarray):
        """The pairs that pass the coordinate test, then the test of their bits."""
        table = self.distances(prints, self.general)
        for i in range(0, len(left), PAIRS):
            a, b = left[i : i + PAIRS], right[i : i + PAIRS]
            for some in (slice(0, 6), slice(6, None)):
                apart = np.abs(table[a, some] - table[b, some]).max(axis=1)
                a, b = a[apart <= self.max_bits], b[apart <= self.max_bits]
            near = np.bitwise_count(prints[a] ^ prints[b]) <= self.max_bits
            yield from zip(a[near].tolist(), b[near].tolist())


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


_CELLS = "path long, code long, print long"


def _deal(max_bits: int):
    """Rows of a cell table to rows of the next cut; the first cut's path is 0."""
    table = PivotTable(max_bits)
    width = len(table.choices) + 1

    def steps(path: int) -> list[int]:
        out = []
        while path:
            path, c = divmod(path, width)
            out.append(c - 1)
        return out[::-1]

    def deal(batches):
        for batch in batches:
            paths = batch.column("path").to_numpy()
            codes = batch.column("code").to_numpy().view(np.uint64)
            prints = batch.column("print").to_numpy().view(np.uint64)
            for path in np.unique(paths).tolist():
                mine = paths == path
                for c, out in table.cells(steps(path), codes[mine], prints[mine]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(out), path * width + c + 1)),
                            pa.array(out.view(np.int64)),
                            pa.array(prints[mine].view(np.int64)),
                        ],
                        names=["path", "code", "print"],
                    )

    return deal


def _link(max_bits: int):
    """Rows sorted by cell to links of near fingerprints, a spanning forest of each batch."""
    table = PivotTable(max_bits)

    def links(path, code, prints):
        fresh = np.r_[True, (path[1:] != path[:-1]) | (code[1:] != code[:-1])]
        ends = np.r_[np.flatnonzero(fresh)[1:], len(path)][np.cumsum(fresh) - 1]
        partners = ends - np.arange(len(path)) - 1
        left = np.repeat(np.arange(len(path)), partners)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners)
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i, j in table.near_pairs(prints, left, right):
            a, b = find(int(prints[i])), find(int(prints[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(prints[i]), int(prints[j])))
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"]
        )

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        for batch in batches:
            cols = [
                batch.column("path").to_numpy(),
                batch.column("code").to_numpy().view(np.uint64),
                batch.column("print").to_numpy().view(np.uint64),
            ]
            held = [np.concatenate(x) for x in zip(held, cols)]
            if not len(held[0]):
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])  # may go on in the next batch
            if not last.all():
                yield links(*(x[~last] for x in held))
                held = [x[last] for x in held]
        if len(held[0]):
            yield links(*held)

    return run


def near_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints of ``print`` within ``max_bits`` bits."""
    out = prints.sparkSession.createDataFrame([], "a long, b long")
    if max_bits == 0:
        return out
    rows = prints.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("code"), "print")
    levels = PivotTable(max_bits).levels()
    for level in range(levels):
        cells = stage(rows.mapInArrow(_deal(max_bits), _CELLS), "pivot_cells")
        sizes = cells.groupBy("path", "code").agg(F.count("*").alias("n")).filter("n > 1")
        shared = stage(cells.join(sizes, ["path", "code"]), "shared_cells")
        last = level == levels - 1
        small = shared if last else shared.filter(F.col("n") <= CELL)
        dealt = small.repartition("path", "code").sortWithinPartitions("path", "code")
        out = out.union(dealt.select("path", "code", "print").mapInArrow(_link(max_bits), "a long, b long"))
        if last or shared.filter(F.col("n") > CELL).isEmpty():
            return out
        rows = shared.filter(F.col("n") > CELL).select("path", "code", "print")
    return out


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """A row for each row of ``docs``: row, doc_id, print (a signed long) and component.

    ``component`` is the smallest doc_id reachable over links of at most ``max_bits`` bits
    between SimHashes of ``shingle``-word shingles (fewer words: the whole sequence; none,
    so also null and empty texts: fingerprint zero, linked like any other). Equal rows and
    equal texts share a fingerprint and hence a component; rows with a null doc_id belong to
    one but never name it, and it is null where all its ids are. ``row`` numbers the rows of
    a table read from files, the same way at each reading. Other columns are not looked at.
    An empty table gives no rows.
    """
    named = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        fingerprints(F.col(text), shingle).alias("print"),
    )
    named = stage(named, "fingerprints")
    prints = stage(named.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(near_links(prints.select("print"), max_bits))
    rooted = prints.join(roots, prints["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    rooted = stage(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named_prints = stage(rooted.join(lowest, "root").select("print", "component"), "print_components")
    return named.join(named_prints, "print").select("row", "doc_id", "print", "component")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, nulls last.

    Of rows that repeat that id the first stays. ``docs`` must be read from files.
    """
    found = stage(near_duplicates(docs, doc_id=doc_id, **options), "duplicates")
    # a component whose ids are all null is told by its fingerprints' smallest row instead
    chosen = found.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")
    )
    kept = chosen.filter(F.col("component").isNotNull()).select(F.col("best.row").alias("row"))
    nameless = found.filter(F.col("component").isNull()).groupBy("print").agg(F.min("row").alias("row"))
    rest = found.join(kept.union(nameless.select("row")), "row", "left_anti").select(F.col("row"))
    row = spare_name(docs, "__row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(rest.withColumnRenamed("row", row), row, "left_anti").drop(row)
