"""Language-model scores from a probabilistic suffix tree over words.

The tree's states are contexts of up to ``depth`` words. A context becomes a candidate when
it makes up at least ``P_MIN`` of the training tokens, so there are at most 1/P_MIN of each
length however large the corpus is; it is retained when its next-word distribution diverges
from that of its longest proper suffix. Distributions are smoothed by Witten-Bell
interpolation along the suffixes down to add-one word frequencies. A word is scored in the
longest retained suffix of what precedes it.

Counts cover all training texts: tasks combine theirs, Spark sums them by key. The
tree and the frequent words, both of bounded size, are broadcast; what rare words add to a
text's score comes from a join with the full word counts.

Texts are cut into words twice: once to count words, once to write each text as the numbers
of its frequent words. Counting contexts and scoring read those numbers.
"""

import itertools
import pickle
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm.common import batch_texts
from dailycast.sources.staging import stage

#: Least share of the training tokens of a context or next word in the tree, and of a word
#: that is looked up on the map side; least count of either.
P_MIN, P_WORD, LEAST = 1e-6, 2e-7, 3
#: Nats that a context's observations must differ from what its suffix predicts.
DIVERGENCE = 15.0
#: Distinct words or n-grams that a task holds before it hands on their counts.
HELD, TOKENS = 1_500_000, 1_000_000
#: Words numbered or scored at once, and frequent words whose numbers a worker keeps.
CHUNK, CACHE_SIZE = 300_000, 1_000_000
_SHIFT = 24

END = b""  # no word is empty


def words_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _counts(keys, numbers):
    for i in range(0, len(keys), 500_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[i : i + 500_000]), pa.array(numbers[i : i + 500_000])], names=["key", "n"]
        )


def _word_counts(batches):
    counts: Counter = Counter()

    def out():
        keys = np.fromiter(map(_hash, counts), np.uint64, len(counts)).view(np.int64)
        yield from _counts(keys, np.fromiter(counts.values(), np.int64, len(counts)))
        counts.clear()

    for batch in batches:
        for text in batch_texts(batch.column(0)):
            counts.update(words_of(text))
            if len(counts) > HELD:
                yield from out()
    yield from out()


class Tree:
    """Frequent words by rank from 1, and the retained n-grams of each length from 2."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, in_tree: int):
        order = np.argsort(hashes)
        self.sorted, self.rank = hashes[order], (order + 1).astype(np.int64)
        self.count = np.r_[0, counts].astype(np.float64)
        self.total, self.distinct, self.in_tree = total, distinct, in_tree
        self.root = (self.count + 1) / (total + distinct + 1)
        self.keys: list[np.ndarray] = []  # by length: previous n-gram's index << 24 | word
        self.seen: list[np.ndarray] = [self.count[: in_tree + 1]]  # occurrences by index from 1
        self.added: list[np.ndarray] = []  # what an n-gram adds to its last word's probability
        self.passed: list[np.ndarray] = []  # share that a context passes to its suffix; 1 if not retained

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        return self.hash_ids(np.fromiter(map(_hash, words), np.uint64, len(words)))

    def hash_ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.rank[at], 0) if len(self.sorted) else np.zeros(len(h), np.int64)

    def grams(self, ids: np.ndarray) -> list[np.ndarray]:
        """For each length the index of the n-gram that ends at each position, 0 for none."""
        last = np.where(ids <= self.in_tree, ids, 0)
        out = [last]
        for keys in self.keys:
            previous = np.r_[0, out[-1][:-1]]
            out.append(_find(keys, (previous << _SHIFT) | last, (previous > 0) & (last > 0)))
        return out

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Keys of the n-grams one longer than the tree has, both of whose parts are in it."""
        grams = self.grams(ids)
        previous = np.r_[0, grams[-1][:-1]]
        good = (previous > 0) & (grams[0] > 0)
        if len(grams) > 1:
            good &= grams[-1] > 0
        return ((previous << _SHIFT) | grams[0])[good]

    def grow(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Take in all frequent n-grams of the next length and test the contexts they follow."""
        order = np.argsort(keys)
        keys, numbers = keys[order], numbers[order].astype(np.float64)
        context, word = keys >> _SHIFT, keys & ((1 << _SHIFT) - 1)
        times = self.seen[-1]
        size = len(times)
        if not self.keys:
            expected = self.count[word] / self.total
        else:  # the suffix drops the context's first word
            suffix = self._suffix(context)
            at = _find(self.keys[-1], (suffix << _SHIFT) | word, suffix > 0)
            expected = np.where(at > 0, self.seen[-1][at] / np.maximum(self.seen[-2][suffix], 1), self.root[word])
        share = numbers / times[context]
        told = np.bincount(context, numbers, size)
        kinds = np.bincount(context, minlength=size)
        gain = np.bincount(context, numbers * np.log(share / expected), size)
        rest = np.maximum(times - told, 0.5)
        rest_expected = np.maximum(1 - np.bincount(context, expected, size), 1e-9)
        gain = gain + rest * np.log(rest / np.maximum(times, 1) / rest_expected)
        kept = (kinds > 0) & (gain > DIVERGENCE)
        weight = times + kinds + 1
        self.passed.append(np.where(kept, (weight - told) / weight, 1.0))
        self.added.append(np.r_[0.0, np.where(kept[context], numbers / weight[context], 0.0)])
        self.keys.append(keys)
        self.seen.append(np.r_[0.0, numbers])

    def _suffix(self, context: np.ndarray) -> np.ndarray:
        """The n-gram without its first word, as an index one length shorter."""
        key = self.keys[-1][context - 1]
        last = key & ((1 << _SHIFT) - 1)
        if len(self.keys) == 1:
            return last
        shorter = Tree.__new__(Tree)
        shorter.keys = self.keys[:-1]
        before = shorter._suffix(key >> _SHIFT)
        return _find(self.keys[-2], (before << _SHIFT) | last, before > 0)

    def probability(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of frequent words the probability, of others the share passed down to the root."""
        grams = self.grams(ids)
        p = np.where(ids > 0, self.root[ids], 1.0)
        for k, (passed, added) in enumerate(zip(self.passed, self.added)):
            context = np.r_[0, grams[k][:-1]]
            p = added[grams[k + 1]] + np.where(context > 0, passed[context], 1.0) * p
        return p, ids > 0


def _find(keys: np.ndarray, wanted: np.ndarray, valid: np.ndarray) -> np.ndarray:
    out = np.zeros(len(wanted), np.int64)
    if len(keys):
        some = np.flatnonzero(valid)
        at = np.minimum(np.searchsorted(keys, wanted[some]), len(keys) - 1)
        out[some] = np.where(keys[at] == wanted[some], at + 1, 0)
    return out


_WORKER: dict = {}


def _held(shared, key: str) -> tuple[Tree, dict]:
    """The broadcast tree and a cache of word numbers, kept by the worker between tasks."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = (pickle.loads(shared.value), {})
    return _WORKER[key]


def _number(words: list[bytes], tree: Tree, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words, 0 for rare ones; positions and hashes of the rare ones."""
    ids = np.fromiter(map(cache.get, words, itertools.repeat(-1)), np.int64, len(words))
    at = np.flatnonzero(ids < 0)
    missed = [words[k] for k in at]
    hashes = np.fromiter(map(_hash, missed), np.uint64, len(missed))
    found = tree.hash_ids(hashes)
    ids[at] = found
    if len(cache) > CACHE_SIZE:
        cache.clear()
    cache.update((missed[k], int(found[k])) for k in np.flatnonzero(found))
    rare = found == 0
    return ids, at[rare], hashes[rare].view(np.int64)


def _offsets(sizes) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)].astype(np.int32)


def _numbered(texts: list[list[bytes]], tree: Tree, cache: dict) -> tuple[pa.Array, pa.Array]:
    """Each text's word numbers as little-endian 32-bit bytes, and its rare words with their counts."""
    sizes = [len(words) for words in texts]
    ids, at, hashes = _number([w for words in texts for w in words], tree, cache)
    ends = pa.py_buffer(_offsets(sizes) * np.int32(4))
    numbers = pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends, pa.py_buffer(ids.astype("<i4"))])
    owner = np.repeat(np.arange(len(sizes)), sizes)[at]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])][: len(owner)])
    times = np.diff(np.r_[first, len(owner)])
    pairs = pa.StructArray.from_arrays([pa.array(hashes[first]), pa.array(times)], names=["key", "times"])
    per_text = np.bincount(owner[first], minlength=len(sizes))
    return numbers, pa.ListArray.from_arrays(pa.array(_offsets(per_text)), pairs)


def _ranges(sizes, most: int):
    """Ranges of rows whose sizes add up to about ``most``."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _spaced(numbers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in one array with a 0 after each text, and where texts start."""
    parts = [np.frombuffer(t, "<i4") for t in numbers.to_pylist()]
    sizes = np.array([len(t) + 1 for t in parts], np.int64)
    gap = np.zeros(1, np.int32)
    flat = np.concatenate([x for t in parts for x in (t, gap)]).astype(np.int64)
    return flat, np.r_[0, np.cumsum(sizes)[:-1]]


def _spaced_chunks(batch: pa.RecordBatch):
    """Parts of a batch with some CHUNK words in column ``ids``, each with its spaced word numbers."""
    column = batch.column("ids").cast(pa.binary())
    sizes = [(n or 0) // 4 for n in pc.binary_length(column).to_pylist()]
    for i, j in _ranges(sizes, CHUNK):
        yield batch.slice(i, j - i), *_spaced(column.slice(i, j - i))


def _gram_counts(shared, key: str):
    """Counts of the next n-grams of a task's texts, by sorted runs merged as they grow."""

    def run(batches):
        tree, _ = _held(shared, key)
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        fresh, size = [], 0

        def merged():
            keys = np.concatenate([k for k, _ in runs] or [np.zeros(0, np.int64)])
            numbers = np.concatenate([n for _, n in runs] or [np.zeros(0, np.int64)])
            unique, at = np.unique(keys, return_inverse=True)
            return unique, np.bincount(at, numbers, len(unique)).astype(np.int64)

        for batch in batches:
            for _, flat, _ in _spaced_chunks(batch):
                fresh.append(tree.candidates(flat))
                size += len(fresh[-1])
                if size > TOKENS:
                    runs.append(np.unique(np.concatenate(fresh), return_counts=True))
                    fresh, size = [], 0
                    if sum(len(k) for k, _ in runs) > 2 * HELD:
                        runs = [merged()]
                        if len(runs[0][0]) > HELD:
                            yield from _counts(*runs.pop())
        if fresh:
            runs.append(np.unique(np.concatenate(fresh), return_counts=True))
        yield from _counts(*merged())

    return run


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select("key", "n").toPandas()
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def _word_root(texts: DataFrame) -> tuple[Tree, DataFrame]:
    """A tree of words alone, from a one-column table of training texts, and all counts (key, n)."""
    sums = texts.mapInArrow(_word_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = stage(sums, "word_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.filter(F.col("n") >= max(LEAST, P_WORD * total))
    keys, numbers = _arrays(frequent)
    order = np.lexsort((keys, -numbers))
    keys, numbers = keys[order], numbers[order]
    in_tree = int((numbers >= max(LEAST, P_MIN * total)).sum())
    return Tree(keys.view(np.uint64), numbers, total, distinct, in_tree), counts


def _number_texts(docs: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, train, ids (word numbers) and rare (words without one) of each row, written once."""
    shared, key = docs.sparkSession.sparkContext.broadcast(pickle.dumps(tree)), uuid.uuid4().hex

    def number(batches):
        tree, cache = _held(shared, key)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            for i, j in _ranges([(n or 0) // 6 for n in sizes], CHUNK):
                part = batch.slice(i, j - i)
                texts = [words_of(t) for t in batch_texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("train"), *_numbered(texts, tree, cache)],
                    names=["doc_id", "train", "ids", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, train boolean, ids binary, rare array<struct<key:long,times:long>>"
    numbered = docs.select("doc_id", "text", "train").mapInArrow(number, columns)
    numbered = stage(numbered.withColumn("row", F.monotonically_increasing_id()), "numbered")
    shared.unpersist()
    return numbered


def _grow(tree: Tree, numbered: DataFrame, depth: int) -> None:
    """Add contexts of up to ``depth`` words, from the column ids of the training texts."""
    for _ in range(depth):
        shared = numbered.sparkSession.sparkContext.broadcast(pickle.dumps(tree))
        grams = numbered.select("ids").mapInArrow(_gram_counts(shared, uuid.uuid4().hex), "key long, n long")
        least = max(LEAST, P_MIN * tree.total)
        tree.grow(*_arrays(grams.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)))
        shared.unpersist()


def fit_tree(texts: DataFrame, depth: int = 2) -> tuple[Tree, DataFrame]:
    """The tree of a one-column table of training texts, and its full word counts (key, n)."""
    tree, counts = _word_root(texts)
    named = texts.select(F.lit(0).alias("doc_id"), F.col(texts.columns[0]).alias("text"), F.lit(True).alias("train"))
    _grow(tree, _number_texts(named, tree), depth)
    return tree, counts


_SCORES = ["n_tokens", "known", "base", "score"]


def _score_numbered(tree: Tree, flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Of each text its tokens, its frequent words, and the log10 sums of both models over them."""
    p, known = tree.probability(flat)
    score = np.log10(p)
    score[np.r_[starts[1:], len(flat)] - 1] = 0.0  # the gaps between texts
    base = np.where(known, np.log10(tree.root)[flat], 0.0)
    sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, score)]
    return [np.diff(np.r_[starts, len(flat)]) - 1, *sums]


def score_documents(docs: DataFrame, train, text: str = "text", doc_id: str = "doc_id", depth: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of each row.

    ``train`` is a condition on ``docs``: rows where it holds are learned from. A-Z count as
    lower case; words are cut at ASCII white space and an end follows. Null and empty texts
    are the end alone. Rows are scored one by one, so repeated rows and null ids are rows
    like others; an empty table gives no rows, and with nothing to learn from every token has
    probability 1. Other columns are not looked at.
    """
    learnt = F.coalesce(F.expr(train) if isinstance(train, str) else train, F.lit(False)).alias("train")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), learnt)
    tree, counts = _word_root(named.filter("train").select("text"))
    numbered = _number_texts(named, tree)
    _grow(tree, numbered.filter("train"), depth)
    shared, key = docs.sparkSession.sparkContext.broadcast(pickle.dumps(tree)), uuid.uuid4().hex

    def score(batches):
        tree, _ = _held(shared, key)
        for batch in batches:
            for part, flat, starts in _spaced_chunks(batch):
                scored = [pa.array(x) for x in _score_numbered(tree, flat, starts)]
                columns = [part.column("row"), part.column("doc_id"), *scored]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *_SCORES])

    kind = named.schema["doc_id"].dataType.simpleString()
    parts = numbered.select("row", "doc_id", "ids").mapInArrow(
        score, f"row long, doc_id {kind}, n_tokens long, known long, base double, score double"
    )
    rest = float(tree.total + tree.distinct + 1)
    rare = numbered.select("row", F.explode("rare").alias("w")).select("row", "w.key", "w.times")
    rare = rare.join(counts, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / rest)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    more = F.coalesce("more", F.lit(0.0))
    return parts.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
