"""Best-fit packing in bulk-synchronous supersteps.

Pieces are range-sorted by length and get a rank within it; gaps are kept sorted by size with
ranks of their own. In a superstep open pieces, longest first, look for their successor, the
smallest gap that still holds them. Sizes are whole numbers, so the sweep over both sorted
tables runs over (size, count) classes, at most ``capacity`` of each, and ranks settle who
gets which gap: each row then finds its partner by its own rank, in a join. A superstep ends
where a length would need gaps that it has changed; these are ranked anew and the next one
goes on from there, until every piece has a place. So the sequences are as many as sequential
best-fit decreasing would open, and a superstep reads only the pieces of its own lengths.
"""

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm.common import batch_texts, spare_name
from dailycast.sources.staging import stage

CAPACITY = 2048
#: New sequences that one row unfolds into.
CHUNK = 50_000
#: Words whose ids a worker remembers, and the longest of them in bytes.
CACHE_SIZE, WORD_BYTES = 400_000, 48


#: Words of letters that neither normalising nor pre-tokenizing changes, case apart.
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbe])+")
_MARKS = frozenset(b".,;:!?")


def _byte_letters() -> list[str]:
    """The letters that byte-level models write bytes as: printable ones as they are."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordIds(dict):
    """Ids of blank-separated words as little-endian 32-bit numbers.

    The tokenizer drops white space, so a text's ids are those of its words in order. Plain
    words go to the tokenizer's model at once; a mark after a letter is a word of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # a new handle at each access
        self.letters = _byte_letters()

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha() or _PLAIN.fullmatch(word):
            letters = word.lower().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(letters)]
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 1 and word[-1] in _MARKS and (word[-2:-1].isalpha() or _PLAIN.fullmatch(word[-3:-1])):
            return self[word[:-1]] + self[word[-1:]]
        value = self._ids(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = value
        return value


_WORKER: dict = {}
_PIECE = pa.struct(
    [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
)


def token_pieces(text, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True):
    """The pieces of a document as an array column: its ids and ``end_id``, cut at ``capacity``.

    ``ids`` holds little-endian 32-bit ids (null unless ``keep_ids``), ``ids_crc32`` their CRC.
    Null and empty texts are the end id alone. Cutting at white space is right for
    tokenizers that drop it. The column is computed row by row: repeated texts repeat their pieces.
    """
    key = (tokenizer_path, uuid.uuid4().hex)
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = WordIds(tokenizer_path)
        lookup = _WORKER[key].__getitem__
        for batch in batches:
            size, number, start, length, crc, ids = [], [], [], [], [], []
            for t in batch_texts(batch):
                raw = b"".join(map(lookup, t.split())) + tail
                steps = range(0, len(raw), 4 * capacity)
                size.append(len(steps))
                for k, i in enumerate(steps):
                    part = raw[i : i + 4 * capacity]
                    number.append(k)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part if keep_ids else None)
            columns = [pa.array(x, f.type) for x, f in zip((number, start, length, crc, ids), _PIECE)]
            ends = pa.array(np.cumsum([0, *size]), pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(_PIECE)))

    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long,ids:binary>>"
    return F.arrow_udf(cut, kind)(text)


class Sweep:
    """One superstep's decisions, from the counts of open pieces and gaps by size.

    Lengths are swept downwards; each takes its successor, the smallest gap that holds it, as
    often as the gap can, and opens sequences when no gap does. So a superstep places as
    sequential best-fit decreasing would. It ends at a length whose successor is among gaps
    that this superstep has changed in bulk: those must be sorted in anew first. A single
    gap that is left part-filled goes on serving shorter lengths, as its place is known.

    ``fits``: pieces of a length, ranks low to high, go to gaps of a size from a rank on,
    ``each`` to a gap, from an offset on. ``opens``: the same for new sequences from a number on.
    ``moves`` and ``made``: the new size and first new rank of gaps of a size, ranks low to
    high, and of new sequences, numbers low to high; gaps too small for any piece are left out.
    ``top`` and ``low``: the longest and shortest length placed.
    """

    def __init__(self, pieces: np.ndarray, placed: np.ndarray, gaps: np.ndarray, opened: int):
        self.left, self.placed, self.opened = pieces.copy(), placed.copy(), opened
        self.capacity = len(gaps) - 1
        self.fits: list[tuple] = []
        self.opens: list[tuple] = []
        # free size -> targets (size of the class or 0 for new sequences, low, high)
        self.ready: dict[int, list[tuple]] = {s: [(s, 0, int(gaps[s]))] for s in np.flatnonzero(gaps).tolist()}
        self.sizes = sorted(self.ready)
        self.waiting: dict[int, list[tuple]] = {}
        self.later: list[int] = []
        lengths = np.flatnonzero(self.left)[::-1].tolist()
        self.top = self.low = lengths[0] if lengths else 0
        for length in lengths:
            self.low = length
            if not self._place(length):
                break
        self._settle(len(gaps))

    def _place(self, length: int) -> bool:
        """Place all pieces of a length; False if the sorted gaps must be brought up to date first."""
        while n := int(self.left[length]):
            at, due = bisect.bisect_left(self.sizes, length), bisect.bisect_left(self.later, length)
            size = self.sizes[at] if at < len(self.sizes) else None
            if due < len(self.later) and (size is None or self.later[due] < size):
                return False
            room = (size or self.capacity) // length
            if size is None:
                some = max(1, n // room)
                target, free = (0, self.opened, self.opened + some), self.capacity
                self.opened += some
            else:
                kind, low, high = self.ready[size].pop()
                some, free = min(high - low, max(1, n // room)), size
                target = (kind, low, low + some)
                if low + some < high:
                    self.ready[size].append((kind, low + some, high))
                elif not self.ready[size]:
                    del self.ready[size], self.sizes[at]
            self._put(length, target, free, min(room, n))
        return True

    def _put(self, length: int, target: tuple, free: int, each: int) -> None:
        kind, first, last = target
        low = int(self.placed[length])
        high = low + each * (last - first)
        self.placed[length] = high
        self.left[length] -= high - low
        base = self.capacity - free
        if kind:
            self.fits.append((length, low, high, kind, first, each, base))
        else:
            self.opens.append((length, low, high, first, each, base))
        free -= each * length
        if free:
            held, sizes = (self.ready, self.sizes) if last - first == 1 else (self.waiting, self.later)
            if free not in held:
                held[free] = []
                bisect.insort(sizes, free)
            held[free].append(target)

    def _settle(self, n: int) -> None:
        """Ranks of the gaps of each size that are left for the next superstep."""
        self.gaps = np.zeros(n, np.int64)
        self.moves: list[tuple] = []
        self.made: list[tuple] = []
        open_lengths = np.flatnonzero(self.left)
        shortest = int(open_lengths[0]) if len(open_lengths) else n
        for held in (self.ready, self.waiting):
            for free in sorted(held):
                for kind, low, high in held[free] if free >= shortest else ():
                    row = (low, high, free, int(self.gaps[free]))
                    if kind:
                        self.moves.append((kind, *row))
                    else:
                        self.made.append(row)
                    self.gaps[free] += high - low


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table bounded by the number of sizes (or of sort partitions); safe to broadcast."""
    return F.broadcast(spark.createDataFrame([tuple(int(x) for x in r) for r in rows], schema))


def _ranked(pieces: DataFrame, length: str, rank: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Pieces range-sorted by length with their rank among those of the same length, and counts.

    Equal lengths may span partitions, so a hot length is no hot task; the first rank of a
    length in a partition is the number of its pieces in earlier ones.
    """
    tie, at = spare_name(pieces, "__tie"), spare_name(pieces, "__at")
    n = max(1, pieces.rdd.getNumPartitions())
    ordered = (
        pieces.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(n, length, tie)
        .sortWithinPartitions(length, tie)
        .drop(tie)
        .withColumn(at, F.monotonically_increasing_id())
    )
    ordered = stage(ordered, "sorted_pieces")
    part = F.shiftright(at, 33)
    runs = ordered.groupBy(part.alias("part"), F.col(length).alias("size")).agg(
        F.min(at).alias("low"), F.count("*").alias("n")
    )
    seen: dict[int, int] = {}
    firsts = []
    for r in sorted(runs.collect(), key=lambda r: r["low"]):
        first = seen.get(r["size"], 0)
        firsts.append((r["part"], r["size"], first - r["low"]))
        seen[r["size"]] = first + r["n"]
    where, size, by = (spare_name(pieces, f"__{c}") for c in ("part", "size", "shift"))
    shift = _small(pieces.sparkSession, firsts, f"`{where}` long, `{size}` long, `{by}` long")
    found = ordered.join(shift, (part == F.col(where)) & (F.col(length) == F.col(size)))
    found = found.withColumn(rank, F.col(at) + F.col(by)).drop(where, size, by, at)
    return stage(found, "ranked_pieces"), sorted(seen.items())


def pack(
    pieces: DataFrame,
    length: str = "length",
    capacity: int = CAPACITY,
    sequence: str = "sequence_id",
    offset: str = "offset",
) -> DataFrame:
    """``pieces`` with the sequence that each is packed into and its place there, both longs.

    Sequences are numbered from 0 and filled without holes from offset 0; they are as many as
    best-fit decreasing opens one piece at a time. Every row is a piece of its own, so ties and
    repeated rows each get a place; which of equal lengths goes where follows their order in
    the table. Lengths must be 1 to ``capacity``, else a
    ValueError. An empty table gives an empty table with the two columns. Other columns
    pass through, whatever their names; those named like the two are replaced.
    """
    spark = pieces.sparkSession
    pieces = stage(pieces.drop(sequence, offset), "pieces")
    bad = pieces.filter(F.col(length).isNull() | (F.col(length) < 1) | (F.col(length) > capacity))
    if not bad.isEmpty():
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    rank = spare_name(pieces, "__rank")
    ranked, counts = _ranked(pieces, length, rank)
    # the pieces travel as one column, so that no name of theirs meets a helper's
    whole = ranked.select(
        F.struct(*pieces.columns).alias("row"), F.col(length).cast("long").alias("length"), F.col(rank).alias("rank")
    )
    left, placed, gap_counts = (np.zeros(capacity + 1, np.int64) for _ in range(3))
    for size, n in counts:
        left[size] = n
    gaps = None
    done: list[DataFrame] = []
    opened = 0
    while left.any():
        step = Sweep(left, placed, gap_counts, opened)
        # pieces lie sorted by length: a superstep reads the files of its own lengths
        mine = whole.filter(F.col("length").between(step.low, step.top))
        nth = F.col("rank") - F.col("lo")
        here = (F.col("length") == F.col("a")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
        place = F.col("first") + F.floor(nth / F.col("each")).cast("long")
        begin = (F.col("base") + nth % F.col("each") * F.col("a")).alias("begin")
        results, next_gaps = [], []
        if step.fits:
            fits = _small(spark, step.fits, "a long, lo long, hi long, size long, first long, each long, base long")
            went = mine.join(fits, here).select("row", "size", place.alias("place"), begin)
            held = gaps.select("seq", F.col("free").alias("size"), "place")
            results.append(went.join(held, ["size", "place"]).select("row", "seq", "begin"))
        if step.opens:
            opens = _small(spark, step.opens, "a long, lo long, hi long, first long, each long, base long")
            results.append(mine.join(opens, here).select("row", place.alias("seq"), begin))
        for rows in results:
            done.append(stage(rows, "placed_pieces"))
        moved = (F.col("at") + F.col("place") - F.col("lo")).alias("place")
        if step.moves:
            moves = _small(spark, step.moves, "size long, lo long, hi long, new long, at long")
            inside = (F.col("free") == F.col("size")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))
            next_gaps.append(gaps.join(moves, inside).select("seq", F.col("new").alias("free"), moved))
        if step.made:
            made = spark.createDataFrame([tuple(map(int, r)) for r in step.made], "lo long, hi long, new long, at long")
            made = made.withColumn("from", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(CHUNK).cast("long")))).repartition("from")
            upto = F.least(F.col("from") + CHUNK, "hi") - 1
            made = made.withColumn("place", F.explode(F.sequence("from", upto)))
            next_gaps.append(made.select(F.col("place").alias("seq"), F.col("new").alias("free"), moved))
        left, placed, gap_counts, opened = step.left, step.placed, step.gaps, step.opened
        if left.any() and next_gaps:
            gaps = next_gaps[0] if len(next_gaps) == 1 else next_gaps[0].union(next_gaps[1])
            gaps = stage(gaps, "gaps")
    if not done:
        empty = F.lit(None).cast("long")
        return pieces.withColumn(sequence, empty).withColumn(offset, empty)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select("row.*", F.col("seq").alias(sequence), F.col("begin").alias(offset))


def document_pieces(
    docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple = ("doc_id",), **options
) -> DataFrame:
    """A row for each piece of each document: the columns ``keep`` and those of ``token_pieces``.

    Every row counts as a document, repeated ones too; null and empty texts give one piece, the
    end id; an empty table gives none. Columns not in ``keep`` are not looked at.
    """
    cut = token_pieces(F.col(text), tokenizer_path, **options)
    return docs.select(*keep, F.explode(cut).alias("__piece")).select(*keep, "__piece.*")
