"""Benchmark decontamination by suffix arrays of the corpus.

Every task builds word-level suffix arrays over shards of its documents and binary-searches
every test suffix in them. Equal ranges give the places of each window; windows that follow
one another on a diagonal join into the longest verbatim matches. Documents never move.
The test set goes out in blocks of bounded size, whatever its own size.
"""

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm.common import batch_texts, spare_name
from dailycast.sources.staging import stage

#: Words of one suffix array, and of one broadcast block of test items.
SHARD_WORDS, BLOCK_WORDS = 1_000_000, 1_000_000
#: Blocks searched in one pass over the documents.
BLOCKS_A_PASS = 4

MATCHES = "array<struct<item_id:string,doc_word:int,item_word:int,length:int>>"

#: A-Z lower-cased; what is neither digit, letter nor beyond ASCII becomes a space.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class TestSuffixes:
    """The suffixes of a block of items that are at least one window long."""

    __test__ = False  # not a test case

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        ids, starts, owner, offset, length, ends = [], [], [], [], [], []
        self.names = [name for name, _ in items]
        at = 0
        for k, (_, text) in enumerate(items):
            words = split_words(text)
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for j in range(max(1, len(words) - window + 1) if words else 0):
                starts.append(at + j)
                owner.append(k)
                offset.append(j)
                length.append(min(window, len(words)))
                ends.append(at + len(words))
            at += len(words)
        self.ids = np.array(ids + [0] * window, np.int32)
        self.start, self.owner = np.array(starts, np.int64), np.array(owner, np.int64)
        self.offset, self.length = np.array(offset, np.int64), np.array(length, np.int64)
        self.widest = int(self.length.max()) if starts else 0
        self.least = int(self.length.min()) if starts else 0
        #: One suffix of each distinct window, and every suffix's window by that number.
        want = self.words(np.arange(len(starts)))
        rows = np.ascontiguousarray(want).view(f"V{max(1, self.widest) * want.itemsize}").ravel()
        _, self.first, self.window = np.unique(rows, return_index=True, return_inverse=True)
        #: The item's words beside a suffix's window, -1 at its ends.
        self.before = np.where(self.offset > 0, self.ids[self.start - 1], -1)
        beyond = self.start + self.length
        self.after = np.where(beyond < np.array(ends, np.int64), self.ids[np.minimum(beyond, len(self.ids) - 1)], -1)

    def words(self, chosen: np.ndarray) -> np.ndarray:
        """The windows of some suffixes, one a row; 0 beyond a short item's end."""
        steps = np.arange(max(1, self.widest))
        found = self.ids[np.minimum(self.start[chosen][:, None] + steps, len(self.ids) - 1)]
        return np.where(steps < self.length[chosen][:, None], found, 0)


def suffix_array(ids: np.ndarray, where: np.ndarray, depth: int) -> np.ndarray:
    """``where`` sorted by the ``depth`` ids that follow each position, by prefix doubling.

    Every position less than ``depth`` behind one of ``where`` is ranked, whether or not it is in
    ``where`` itself: the halves that are compared begin there. ``where`` names no position twice.
    """
    bits = max(1, int(ids.max(initial=0)).bit_length())
    known = max(1, 62 // bits)
    padded = np.concatenate([ids, np.zeros(2 * max(known, depth) + 1, ids.dtype)]).astype(np.int64)
    at = where
    if known < depth:
        edges = np.zeros(len(padded), np.int32)
        edges[where] += 1
        edges[where + depth] -= 1
        at = np.flatnonzero(np.cumsum(edges))
    key = np.zeros(len(at), np.int64)
    for j in range(min(known, depth)):
        key = (key << bits) | padded[at + j]
    rank = np.zeros(len(padded), np.int64)
    while known < depth:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[at[order]] = np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]]) if len(at) else 0
        if 2 * known >= depth:
            at = where
        key = (rank[at] << 31) | rank[np.minimum(at + known, len(rank) - 1)]
        known *= 2
    return at[np.argsort(key, kind="stable")]


def _reaches(ids: np.ndarray, least: int) -> np.ndarray:
    """Positions with ``least`` test words from there on; no other suffix can hold a window."""
    absent = np.where(ids == 0, np.arange(len(ids)), len(ids))
    following = np.minimum.accumulate(absent[::-1])[::-1]
    return np.flatnonzero(following - np.arange(len(ids)) >= least)


def _bound(ids, array, tests, chosen, upper: bool) -> np.ndarray:
    """First place in the suffix array whose window is at least (``upper``: above) each suffix."""
    steps = np.arange(tests.widest)
    want = tests.words(chosen)
    inside = steps < tests.length[chosen][:, None]
    lo = np.zeros(len(chosen), np.int64)
    hi = np.full(len(chosen), len(array), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        have = ids[array[mid][:, None] + steps]
        differs = (have != want[open_]) & inside[open_]
        first = differs.argmax(axis=1)
        rows = np.arange(len(open_))
        gap = np.where(differs[rows, first], have[rows, first].astype(np.int64) - want[open_][rows, first], 0)
        right = (gap < 0) | (upper & (gap == 0))
        lo[open_] = np.where(right, mid + 1, lo[open_])
        hi[open_] = np.where(right, hi[open_], mid)


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one range after another."""
    return np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def _run_ends(tests, beside: np.ndarray, window: np.ndarray, place: np.ndarray, word: np.ndarray):
    """Pairs of a place and a suffix of its window whose words ``beside`` the window differ.

    Those are where diagonals of equal words end, so nothing is listed twice: repeated words
    give one pair a diagonal, not one a window. Sorted by item, diagonal and place.
    """
    key = (tests.window << 32) | (beside + 1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    low, high = (np.searchsorted(key, (window + i) << 32) for i in (0, 1))
    same = (window << 32) | (word + 1)
    cut = [np.searchsorted(key, same, side) for side in ("left", "right")]
    counts = [cut[0] - low, high - cut[1]]
    suffix = order[np.concatenate([_ranges(low, counts[0]), _ranges(cut[1], counts[1])])]
    places = np.concatenate([np.repeat(place, n) for n in counts])
    by = np.lexsort((places, places - tests.offset[suffix], tests.owner[suffix]))
    return places[by], suffix[by]


def shard_matches(ids: np.ndarray, tests: TestSuffixes):
    """Maximal verbatim matches of at least a window: position, item, item word, length.

    ``ids`` holds the documents' test-word numbers, 0 for other words and between documents.
    Every distinct window is searched once. The longest match of a suffix that fills its window
    is the diagonal of equal words it lies on; work and memory follow the number of places and
    of diagonals, not that of pairs of equal windows.
    """
    none = np.zeros(0, np.int64)
    where = _reaches(ids, tests.least) if tests.widest else none
    if not len(where):
        return none, none, none, none
    array = suffix_array(ids, where, tests.widest)
    padded = np.concatenate([ids, np.zeros(tests.widest + 1, ids.dtype)])
    low = _bound(padded, array, tests, tests.first, upper=False)
    near = padded[array[np.minimum(low, len(array) - 1)][:, None] + np.arange(tests.widest)]
    short = np.arange(tests.widest) >= tests.length[tests.first][:, None]
    agree = ((near == tests.words(tests.first)) | short).all(axis=1)
    window = np.flatnonzero(agree & (low < len(array)))
    if not len(window):
        return none, none, none, none
    times = _bound(padded, array, tests, tests.first[window], upper=True) - low[window]
    place = array[_ranges(low[window], times)]
    window = np.repeat(window, times)
    width = tests.length[tests.first[window]]
    left = np.where(place > 0, padded[place - 1], 0).astype(np.int64)
    first, suffix = _run_ends(tests, tests.before, window, place, left)
    last, at_end = _run_ends(tests, tests.after, window, place, padded[place + width].astype(np.int64))
    return first, tests.owner[suffix], tests.offset[suffix], last - first + tests.length[at_end]


def find_matches(texts: list[bytes], tests: TestSuffixes) -> tuple[list[int], list[list[dict]]]:
    """Word counts and matches of some documents, one suffix array to a shard of them."""
    counts: list[int] = []
    out: list[list[dict]] = [[] for _ in texts]
    held: list[np.ndarray] = []
    starts, docs, at = [], [], 0
    gap = np.zeros(1, np.int32)

    def close():
        place, item, offset, length = shard_matches(np.concatenate(held), tests)
        owner = np.searchsorted(np.array(starts), place, "right") - 1
        for p, i, o, n, d in zip(*(x.tolist() for x in (place, item, offset, length, owner))):
            out[docs[d]].append(
                {"item_id": tests.names[i], "doc_word": p - starts[d], "item_word": o, "length": n}
            )

    for k, text in enumerate(texts):
        words = split_words(text)
        counts.append(len(words))
        if not words:
            continue
        starts.append(at)
        docs.append(k)
        held += [np.fromiter(map(tests.vocabulary.get, words, repeat(0)), np.int32, len(words)), gap]
        at += len(words) + 1
        if at >= SHARD_WORDS:
            close()
            held, starts, docs, at = [], [], [], 0
    if held:
        close()
    return counts, out


def blocks(benchmark: DataFrame, item_id: str, text: str, size: int = BLOCK_WORDS):
    """The test items, fetched a block at a time; only one block is in the driver at once."""
    block, words = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text))
    for name, body in rows.toLocalIterator():
        raw = (body or "").encode()
        n = len(split_words(raw))
        if n:
            block.append((name, raw))
            words += n
        if words >= size:
            yield block
            block, words = [], 0
    if block:
        yield block


_WORKER: dict = {}


def _search(block, window: int):
    """A column function: struct of word count and matches with one block of items."""
    key = uuid.uuid4().hex
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            (
                "matches",
                pa.list_(
                    pa.struct(
                        [
                            ("item_id", pa.string()),
                            ("doc_word", pa.int32()),
                            ("item_word", pa.int32()),
                            ("length", pa.int32()),
                        ]
                    )
                ),
            ),
        ]
    )

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _WORKER:
            if len(_WORKER) >= BLOCKS_A_PASS:
                _WORKER.clear()
            _WORKER[key] = TestSuffixes(block.value, window)
        for batch in batches:
            counts, found = find_matches(batch_texts(batch), _WORKER[key])
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(found, kind.field("matches").type)],
                fields=list(kind),
            )

    return F.arrow_udf(search, f"struct<n_words:long,matches:{MATCHES}>")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    out: str = "contamination",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, items and matches of each text.

    ``matches`` are the maximal verbatim matches of at least ``window`` words (of all its
    words, for a shorter item) with their places in document and item; ``n_hit`` counts the
    document's words inside any of them, ``items`` are the distinct item ids, sorted.
    Null or empty texts have no words and no matches; null or wordless items match nothing;
    a null item id reads as ''. Each document row is judged by itself and keeps its columns,
    so repeated rows, null ids and clashing names are harmless (``out`` is replaced). An
    empty benchmark finds nothing. Repeated items count once per id.
    """
    sc = docs.sparkSession.sparkContext
    mine = spare_name(docs, "__found")
    texts = F.col(text)
    found, waiting = None, []
    df = docs

    def settle(df, found, columns):
        parts = [c["matches"] for c in columns]
        both = F.concat(*([found["matches"]] if found is not None else []), *parts)
        return df.withColumn(
            mine, F.struct(columns[0]["n_words"].alias("n_words"), both.alias("matches"))
        )

    for block in blocks(benchmark, item_id, item_text, block_words):
        if len(waiting) == BLOCKS_A_PASS:
            df, waiting = stage(settle(df, found, waiting), "matches"), []
            found = F.col(mine)
        waiting.append(_search(sc.broadcast(block), window)(texts))
    if not waiting:
        waiting = [_search(sc.broadcast([]), window)(texts)]
    df = settle(df, found, waiting)
    matches = F.col(mine)["matches"]
    spans = F.array_sort(
        F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["length"]).alias("z")))
    )
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(
            (s["hit"] + F.greatest(x["z"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("hit"),
            F.greatest(s["end"], x["z"]).alias("end"),
        ),
    )
    items = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))
    return df.withColumn(
        out,
        F.struct(
            F.col(mine)["n_words"].alias("n_words"),
            covered["hit"].cast("long").alias("n_hit"),
            items.alias("items"),
            matches.alias("matches"),
        ),
    ).drop(mine)


def contaminated(found, share: int = 20):
    """Whether at least one word in ``share`` lies in a match; a column."""
    return (found["n_hit"] > 0) & (share * found["n_hit"] >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the affected documents; see ``find_contamination`` for the cases."""
    out = spare_name(docs, "__contamination")
    found = find_contamination(docs, benchmark, out=out, **options)
    return found.filter(~contaminated(F.col(out))).drop(out)
