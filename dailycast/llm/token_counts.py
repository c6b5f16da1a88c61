"""Token counts of whole texts by a two-tier lookup on the map side.

A pre-token here is a piece of text between two single spaces. The tokenizer's own
pattern may split it further but never joins two of them, so a text's count is the
sum over its pieces. Tier one is a table of frequent pieces with their lengths,
measured over all rows and broadcast; tier two a cache in each Python worker, filled
by encoding what tier one misses. Pre-tokens are never shuffled; one bounded summary
per task is.
"""

import json
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the broadcast table: at most this many pieces of at most this many characters.
TABLE_SIZE, PIECE_CHARS = 65_536, 64
#: Pieces a task reports, and pieces it holds while it counts.
SUMMARY_SIZE, HELD = 16_384, 400_000
#: Pieces a worker remembers beside the table.
CACHE_SIZE = 500_000

#: White space that the pattern of byte-level BPE and Python's split judge alike.
_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def _summary(batches):
    """One row per task: its most frequent pieces. Rare ones may be forgotten on the way."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(text.split(" "))
                if len(counts) > HELD:
                    counts = Counter(dict(counts.most_common(HELD // 4)))
    yield _summary_row(counts)


def _summary_row(counts: Counter) -> pa.RecordBatch:
    top = [(k, n) for k, n in counts.most_common(2 * SUMMARY_SIZE) if 0 < len(k) <= PIECE_CHARS]
    top = top[:SUMMARY_SIZE]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([[k for k, _ in top]], pa.list_(pa.string())),
            pa.array([[n for _, n in top]], pa.list_(pa.int64())),
        ],
        names=["piece", "n"],
    )


def _merge(rows: pa.Table) -> pa.Table:
    counts: Counter = Counter()
    for pieces, numbers in zip(rows["piece"].to_pylist(), rows["n"].to_pylist()):
        for k, n in zip(pieces, numbers):
            counts[k] += n
    return pa.Table.from_batches([_summary_row(counts)])


def frequent_pieces(texts: DataFrame, size: int = TABLE_SIZE) -> list[str]:
    """The most frequent pieces of a one-column table of texts, measured over all rows.

    Every task summarises what it reads; about sqrt(tasks) groups of summaries are
    merged on executors, and the driver merges those. Only speed depends on the
    outcome, never a count.
    """
    slots = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    parts = texts.mapInArrow(_summary, "piece array<string>, n array<long>")
    merged = (
        parts.withColumn("slot", F.spark_partition_id() % slots)
        .groupBy("slot")
        .applyInArrow(_merge, "piece array<string>, n array<long>")
    )
    counts: Counter = Counter()
    for row in merged.toLocalIterator():
        for k, n in zip(row["piece"], row["n"]):
            counts[k] += n
    return [k for k, _ in counts.most_common(size)]


class PieceLengths(dict):
    """Lengths of pieces that follow one space; both tiers in one lookup."""

    def __init__(self, path: str, frequent: list[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = list(self.tokenizer.get_added_tokens_decoder().values())
        self.mark = special[0].content if special else None
        self.mark_id = self.tokenizer.token_to_id(self.mark) if self.mark else None
        self.todo: list[str] = []
        self.first_tier = dict(zip(frequent, self.encode([" " + k for k in frequent])))
        self.update(self.first_tier)

    def __missing__(self, piece: str) -> int:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Irregular
        self.todo.append(" " + piece)
        return 0

    def encode(self, strings: list[str]) -> list[int]:
        """Token counts of strings, many to a call, a special token between them."""
        out: list[int] = []
        for i in range(0, len(strings), 64):
            some = strings[i : i + 64]
            if self.mark is None or any(self.mark in s for s in some):
                got = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
                out += [len(e) for e in got]
                continue
            ids = self.tokenizer.encode_batch_fast(
                [self.mark.join(some)], add_special_tokens=False
            )[0].ids
            before = -1
            for at in [k for k, x in enumerate(ids) if x == self.mark_id] + [len(ids)]:
                out.append(at - before - 1)
                before = at
        return out

    def remember(self, lengths: dict[str, int]) -> None:
        if len(self) + len(lengths) > CACHE_SIZE + len(self.first_tier):
            self.clear()
            self.update(self.first_tier)
        for s, n in lengths.items():
            if s[0] == " " and 1 < len(s) <= PIECE_CHARS and not (s[1].isspace() or s[-1].isspace()):
                self[s[1:]] = n

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """The part of a text's count that is known, and the strings still to encode."""
        self.todo = []
        try:
            head, *rest = text.split(" ")
            if head and rest and head[-1].isspace():
                raise _Irregular
            known = sum(map(self.__getitem__, rest))
            return known, [head, *self.todo] if head else self.todo
        except _Irregular:
            pass
        if _ODD_SPACE.search(text):
            return 0, [text]
        known, todo = 0, []
        for s in _CHUNK.findall(text):
            n = self.get(s[1:]) if s[0] == " " and len(s) > 1 else None
            if n is None:
                todo.append(s)
            else:
                known += n
        return known, todo

    def counts(self, texts: list) -> list[int]:
        totals: list[int] = []
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for i, text in enumerate(texts):
            known, todo = self.pieces(text) if text else (0, [])
            totals.append(known)
            if todo:
                waiting.append((i, todo))
                held += len(todo)
            if held and (held > 20_000 or i == len(texts) - 1):
                self._settle(totals, waiting)
                waiting, held = [], 0
        if held:
            self._settle(totals, waiting)
        return totals

    def _settle(self, totals: list[int], waiting: list[tuple[int, list[str]]]) -> None:
        strings = list(dict.fromkeys(s for _, todo in waiting for s in todo))
        lengths = dict(zip(strings, self.encode(strings)))
        for i, todo in waiting:
            totals[i] += sum(map(lengths.__getitem__, todo))
        self.remember(lengths)


class _Irregular(Exception):
    """White space other than single spaces between pieces."""


def _check(path: str) -> None:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        raise ValueError("only byte-level BPE without normalizer and prefix space can be cut at spaces")


#: The lookup of the query that a Python worker serves, kept from task to task.
_WORKER: dict = {}


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    out: str = "n_tokens",
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """``docs`` with the number of tokens of each whole text as a long column ``out``.

    No begin, end or added special tokens; a special token's string inside a text counts
    as that token, as is the library's default. Null and empty texts have no tokens.
    Every row keeps all its columns and is counted by itself, so repeated rows, ties and
    null ids need no care; a column already named ``out`` is replaced. The tokenizer file
    must be at ``tokenizer_path`` on every machine.
    """
    _check(tokenizer_path)
    sc = docs.sparkSession.sparkContext
    frequent = sc.broadcast(frequent_pieces(docs.select(F.col(text)), table_size))

    key = (tokenizer_path, uuid.uuid4().hex)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = PieceLengths(tokenizer_path, frequent.value)
        for batch in batches:
            yield pa.array(_WORKER[key].counts(batch.to_pylist()), pa.int64())

    return docs.withColumn(out, F.arrow_udf(count, "long")(F.col(text)))
