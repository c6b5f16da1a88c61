"""Alignment of two tokenizers over a corpus: groups of tokens between common ends, counted links.

Most groups pair one token with the one of the same bytes. An array from every id of the first
tokenizer to that id of the second is made once; groups that follow it are counted in a vector
as long as the vocabulary. Links of all other groups are counted as pairs, in a shuffle that
only they enter. With the counts known, each document's distinct links are scored; they are
written down beside it, so that no text is tokenized twice.

Both tokenizers break before a single blank that stands between other characters, between a
letter and a mark, and around a line end, so texts are cut there, and a worker aligns each
distinct piece once. When it holds many, it keeps those that it met again.
"""

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from dailycast.llm.bpe_stream import Rules, byte_letters
from dailycast.llm.common import held, spare_name
from dailycast.sources.staging import stage

#: Pieces, and links of pieces, that a worker remembers; characters aligned in one step.
CACHE_SIZE, CACHE_LINKS, HELD = 300_000, 4_000_000, 1 << 20
#: Pairs whose counts are broadcast, the most frequent ones; documents' other links are joined.
TABLE_SIZE = 500_000

#: A blank before which both tokenizers always break.
_BREAK = re.compile(r"(?<! ) (?=\S)")
#: White space beyond ASCII; texts with any are cut at ``_BREAK`` alone.
_ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters and marks between which byte-level pre-tokenizing always breaks.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What byte-level pre-tokenizing takes as one: letters, digits or marks, a blank before them; a line end.
_PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]){1,99}|[0-9]{1,99}|[!-&(-/:-@[-`{-~]{1,99})|\n")
#: Bytes that no text has: one ends a piece, the other begins one that has no blank before it.
_CUT, _JOINED = 0xFE, 0xFF
#: A model without the blank put before a text: what follows a model file overrides it.
_NO_PREFIX = b"\x1a\x02\x18\x00"
_OTHER, _LETTER, _SECOND, _LATIN, _FAR, _MARK, _SPACE, _LINE, _BLANK = range(9)


class Aligner:
    """Both tokenizers, their tokens' bytes, and the array of ids with equal bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("the first tokenizer must be byte-level BPE without normalizer and prefix space")
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(path_b, "rb") as f:
            model = f.read()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model + _NO_PREFIX)
        if self.b.encode(" a b") != sentencepiece.SentencePieceProcessor(model_proto=model).encode("a b"):
            raise ValueError("the second tokenizer must put a blank before a text")
        shown, vocab = byte_letters(), spec["model"]["vocab"]
        byte = {c: k for k, c in enumerate(shown)}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in vocab.items():
            self.bytes_a[k] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rules = Rules([(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], {k: len(t) for t, k in vocab.items()})
        self.letters = np.array([vocab[c] for c in shown], np.int64)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the second tokenizer has pieces that go on behind a blank")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ]
        self.kinds = self._kinds(pieces)
        ids: dict[bytes, int] = {}
        for k, raw in enumerate(self.bytes_b):  # whole pieces before single bytes
            if raw not in ids or self.b.is_byte(ids[raw]):
                ids[raw] = k
        self.same = np.array([ids.get(raw, -1) for raw in self.bytes_a], np.int64)
        self.size_a, self.size_b = (np.array([len(x) for x in raw]) for raw in (self.bytes_a, self.bytes_b))
        self.told = [b"%d|%d" % x for x in enumerate(self.same.tolist())]

    @staticmethod
    def _kinds(pieces: list[str]) -> bytes:
        """The kind of every byte; marks and line ends that a piece of the second tokenizer goes on over are no such."""
        kinds = np.full(256, _OTHER, np.uint8)
        kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
        kinds[[k for k in range(0x80, 0xC0) if k not in (0x97, 0xB7)]] = _SECOND  # of a letter, if behind the next kind
        kinds[0xC3], kinds[[0xC2, 0xE1, 0xE2, 0xE3]] = _LATIN, _FAR
        over = set("".join(re.findall(f"(?<=[{_LETTERS}])[{re.escape(_MARKS)}]", "\n".join(pieces))))
        kinds[[ord(m) for m in _MARKS if m not in over]] = _MARK
        kinds[[*range(0x09, 0x0E), *range(0x1C, 0x20)]] = _SPACE
        kinds[0x0A] = _SPACE if any("\n" in p for p in pieces) else _LINE
        kinds[0x20] = _BLANK
        return kinds.tobytes()

    def cut(self, text: str) -> list[bytes]:
        """The pieces of a blank and a text: without their first blank, or with a byte that says there is none."""
        raw = text.encode()
        kind = np.frombuffer((b" " + raw).translate(self.kinds), np.uint8)
        if (kind == _FAR).any() and _ODD_SPACE.search(text):
            head, *rest = _BREAK.split(" " + text)
            return [x.encode() for x in ([head[1:]] if head else []) + rest]
        space, line, blank = kind >= _SPACE, kind == _LINE, kind == _BLANK
        letter = kind == _LETTER
        letter[1:] |= (kind[1:] == _SECOND) & (kind[:-1] == _LATIN)
        alone = line[1:] & ~space[:-1]  # what comes before it is no white space
        joined = alone | (kind[1:] == _MARK) & letter[:-1]
        joined[1:] |= alone[:-1] & ~space[2:]
        ends = blank[1:].copy()
        ends[-1:] = False
        ends[:-1] &= ~blank[:-2] & ~space[2:]
        out = np.frombuffer(raw, np.uint8).copy()
        out[ends] = _CUT
        at = np.flatnonzero(joined)
        return np.insert(out, np.repeat(at, 2), np.tile(np.array([_CUT, _JOINED], np.uint8), len(at))).tobytes().split(b"\xfe")

    def encode_a(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has.

        Plain ones are merged together, by the same merge list as the library's.
        """
        plain = np.array([_PLAIN.fullmatch(x) is not None for x in raw], bool)
        parts = [x for x, p in zip(raw, plain.tolist()) if p]
        rest = [x.decode() for x, p in zip(raw, plain.tolist()) if not p]
        got = [e.ids for e in self.a.encode_batch_fast(rest, add_special_tokens=False)] if rest else []
        letters = self.letters[np.frombuffer(b"".join(parts), np.uint8)]
        merged, sizes = self.rules.merge_many(letters, np.array([len(x) for x in parts], np.int64))
        n = np.zeros(len(raw), np.int64)
        n[plain], n[~plain] = sizes, [len(x) for x in got]
        ids, of_plain = np.zeros(n.sum(), np.int64), np.repeat(plain, n)
        ids[of_plain], ids[~of_plain] = merged, list(chain.from_iterable(got))
        return ids, n

    def encode_b(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.b.encode(raw, num_threads=1)
        return np.array(list(chain.from_iterable(got)), np.int64), np.array([len(x) for x in got], np.int64)

    def whole(self, raw: list[bytes], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which pieces both tokenizers give back byte for byte."""
        out = np.ones(len(raw), bool)
        for ids, n, table, size in ((a, n_a, self.bytes_a, self.size_a), (b, n_b, self.bytes_b, self.size_b)):
            told = b"".join(map(table.__getitem__, ids.tolist()))
            ends = np.append(0, np.cumsum(size[ids]))[np.cumsum(n)].tolist()
            if told != b"".join(raw) or ends != np.cumsum([len(x) for x in raw]).tolist():
                out &= [told[i:j] == x for i, j, x in zip([0, *ends], ends, raw)]
        return out


class _Numbers(dict):
    """Numbers of pieces; a new one gets the next and is noted down."""

    def __init__(self, pieces: Iterable[bytes] = ()):
        super().__init__((p, k) for k, p in enumerate(pieces))
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class Book:
    """Distinct pieces with what their alignment gives, numbered in the order in which they came.

    ``sums`` holds each piece's tokens of both kinds, groups and links, ``texts`` its groups as
    text. ``links`` are pairs as one number, piece by piece: ``odd`` those of irregular groups,
    ``same`` the others, which the first id of alone tells; ``at`` is where a piece's begin.
    """

    def __init__(self, aligner: Aligner):
        self.aligner, self.width = aligner, len(aligner.bytes_b)
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.texts: list[bytes] = []
        self.fine = bytearray()
        self.sums = array("q")
        self.same, self.same_n, self.same_at, self.odd, self.odd_n, self.odd_at = (array("q") for _ in range(6))

    def full(self) -> bool:
        return len(self.texts) > CACHE_SIZE or len(self.same) + len(self.odd) > CACHE_LINKS

    def forget(self, seen: np.ndarray) -> None:
        """Keep pieces that were met more than once, given how often, and of those what fills half at most."""
        links = _view(self.same_n) + _view(self.odd_n)
        often = np.flatnonzero(seen > 1)
        often = often[np.argsort(-seen[often], kind="stable")][: CACHE_SIZE // 2]
        kept = np.sort(often[np.cumsum(links[often]) <= CACHE_LINKS // 2])
        pieces, texts, fine = list(self.number), self.texts, np.frombuffer(bytes(self.fine), np.uint8)
        sums = _view(self.sums).reshape(-1, 4)[kept]
        taken = [(*_taken(values, n, at, kept), _view(n)[kept]) for values, n, at in self.lists()]
        self.clear()
        self.number = _Numbers(map(pieces.__getitem__, kept.tolist()))
        self.texts += map(texts.__getitem__, kept.tolist())
        self.fine += fine[kept].tobytes()
        self.sums.frombytes(sums.tobytes())
        for (values, n, at), new in zip(self.lists(), taken):
            for into, x in zip((values, at, n), new):
                into.frombytes(x.tobytes())

    def lists(self) -> tuple:
        """Of links along the identity array and of others: all, how many a piece has, where its begin."""
        return (self.same, self.same_n, self.same_at), (self.odd, self.odd_n, self.odd_at)

    def learn(self, pieces: list[bytes]) -> None:
        """Align new pieces, all at once: a link ends wherever a token of either side does."""
        if not pieces:
            return
        raw = [p[1:] if p[:1] == b"\xff" else b" " + p for p in pieces]
        aligner = self.aligner
        (a, n_a), (b, n_b) = aligner.encode_a(raw), aligner.encode_b(raw)
        fine = aligner.whole(raw, a, n_a, b, n_b)
        of_a, of_b = np.repeat(np.arange(len(raw)), n_a), np.repeat(np.arange(len(raw)), n_b)
        a, of_a, b = a[fine[of_a]], of_a[fine[of_a]], b[fine[of_b]]
        end_a, end_b = np.cumsum(aligner.size_a[a]), np.cumsum(aligner.size_b[b])
        marks = np.zeros(int(max(end_a[-1:].sum(), end_b[-1:].sum())) + 1, np.int8)
        marks[end_a] = 1
        marks[end_b] |= 2
        ends = np.flatnonzero(marks)
        of_one, of_other = marks[ends] & 1 > 0, marks[ends] & 2 > 0
        at_a, at_b = np.cumsum(of_one) - of_one, np.cumsum(of_other) - of_other
        link_a, link_b, piece = a[at_a], b[at_b], of_a[at_a]
        last = of_one & of_other  # of a group
        group = np.cumsum(last) - last
        links = np.bincount(group, minlength=int(last.sum()))
        straight = (links[group] == 1) & (aligner.same[link_a] == link_b)
        found = (link_a[straight], piece[straight]), ((link_a * self.width + link_b)[~straight], piece[~straight])
        for (values, n, at), (mine, of) in zip(self.lists(), found):
            counts = np.bincount(of, minlength=len(raw))
            at.frombytes((len(values) + np.cumsum(counts) - counts).tobytes())
            n.frombytes(counts.tobytes())
            values.frombytes(mine.tobytes())

        texts = list(map(aligner.told.__getitem__, link_a[last].tolist()))
        to_a, to_b = ((np.append(0, x[last] + 1)).tolist() for x in (at_a, at_b))
        list_a, list_b = a.tolist(), b.tolist()
        for g in np.flatnonzero(~straight[last]).tolist():
            one, other = list_a[to_a[g] : to_a[g + 1]], list_b[to_b[g] : to_b[g + 1]]
            texts[g] = f"{','.join(map(str, one))}|{','.join(map(str, other))}".encode()
        n_groups = np.bincount(piece[last], minlength=len(raw))
        at = np.append(0, np.cumsum(n_groups)).tolist()
        self.texts += [b";".join(texts[i:j]) for i, j in zip(at, at[1:])]
        self.fine += fine.tobytes()
        numbers = (n_a * fine, n_b * fine, n_groups, np.bincount(piece, minlength=len(raw)))
        self.sums.frombytes(np.column_stack(numbers).astype(np.int64).tobytes())

    def read(self, texts: list) -> Iterator[list]:
        """Blocks of texts as piece numbers in order; None for a text that has no tokens.

        Numbers hold until ``clear`` or ``forget``; no block is made of more than about ``HELD`` characters.
        """
        rows: list[np.ndarray | None] = []
        size = 0
        for at, text in enumerate(texts):
            pieces = self.aligner.cut(text) if text else None
            rows.append(None if pieces is None else np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces)))
            size += len(text or "")
            if size < HELD and at < len(texts) - 1:
                continue
            new, self.number.new = self.number.new, []
            self.learn(new)
            fine = np.frombuffer(bytes(self.fine), np.bool_)
            yield [r if r is not None and fine[r].all() else None for r in rows]
            rows, size = [], 0


def _view(values: array) -> np.ndarray:
    """Not to be kept: an array that is looked at cannot grow."""
    return np.frombuffer(values, np.int64)


def _taken(values: array, n: array, at: array, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of some pieces, one piece after the other, and where each one's begin."""
    n, at = _view(n)[pieces], _view(at)[pieces]
    starts = np.cumsum(n) - n
    return _view(values)[np.repeat(at - starts, n) + np.arange(n.sum())], starts


def _links(book: Book, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct links of some documents, by document: how many each has, the pairs, how often they occur."""
    sizes = [0 if r is None else len(r) for r in rows]
    pieces = np.concatenate([np.zeros(0, np.int64), *(r for r in rows if r is not None)])
    doc = np.repeat(np.arange(len(rows)), sizes)
    span = len(book.aligner.bytes_a) * book.width
    codes = []
    for values, n, at in book.lists():
        found, _ = _taken(values, n, at, pieces)
        keys = found if values is book.odd else found * book.width + book.aligner.same[found]
        codes.append(np.repeat(doc, _view(n)[pieces]) * span + keys)
    codes, times = np.unique(np.concatenate(codes), return_counts=True)
    return np.bincount(codes // span, minlength=len(rows)), codes % span, times


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_KIND = ",".join(f"{n} long" for n in _NUMBERS) + ",groups_sha256 string,keys array<long>,times array<long>"
_PAIR = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def _documents(book: Book, rows: list) -> pa.StructArray:
    """What ``_KIND`` says of each document."""
    sums = _view(book.sums).reshape(-1, 4)
    numbers = np.array([sums[r].sum(axis=0) if r is not None else np.zeros(4, np.int64) for r in rows]).reshape(-1, 4)
    digests = [
        hashlib.sha256(b";".join(map(book.texts.__getitem__, r.tolist()))).hexdigest() if r is not None else "" for r in rows
    ]
    sizes, keys, times = _links(book, rows)
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    columns = [pa.array(numbers[:, i]) for i in range(4)] + [pa.array(digests)]
    columns += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys, times)]
    return pa.StructArray.from_arrays(columns, names=[*_NUMBERS, "groups_sha256", "keys", "times"])


def _counts(book: Book, seen: np.ndarray) -> pa.RecordBatch:
    """How often each link was met, given how often each piece was: first the vector (b is null), then the pairs."""
    seen = np.pad(seen, (0, len(book.texts) - len(seen)))
    vector = np.zeros(len(book.aligner.same), np.int64)
    np.add.at(vector, _view(book.same), np.repeat(seen, _view(book.same_n)))
    keys, at = np.unique(_view(book.odd), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.repeat(seen, _view(book.odd_n)))
    met, ids = n > 0, np.flatnonzero(vector)
    keys = keys[met]
    a, b = np.concatenate([ids, keys // book.width]), np.concatenate([np.full(len(ids), -1), keys % book.width])
    columns = [pa.array(a, pa.int32()), pa.array(b, pa.int32(), mask=b < 0), pa.array(np.concatenate([vector[ids], n[met]]))]
    return pa.RecordBatch.from_arrays(columns, schema=_PAIR)


def align_documents(docs: DataFrame, path_a: str, path_b: str, text: str, keep: tuple, made: str, pair: str) -> DataFrame:
    """One pass over the texts: each row's ``keep`` and alignment ``made``, and each task's counts ``pair``.

    A row has the one or the other. A task keeps the counts of links along the identity array in
    a vector and adds up the other pairs; it gives both out when its pieces are forgotten.
    """
    kept = docs.select(*keep)
    schema = StructType([StructField(f.name, f.dataType) for f in kept.schema])
    schema = schema.add(made, StructType.fromDDL(_KIND)).add(pair, StructType.fromDDL("a int, b int, n long"))
    names, key = schema.names, ("align", path_a, path_b)

    def counted(book: Book, seen: np.ndarray, kinds: list) -> pa.RecordBatch:
        pairs = _counts(book, seen)
        columns = [pa.nulls(len(pairs), k) for k in kinds]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(pairs), made_kind), pairs.to_struct_array()], names=names)

    made_kind = _documents_kind()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = held(key, lambda: Book(Aligner(path_a, path_b)))
        seen, kinds = np.zeros(0, np.int64), []
        for batch in batches:
            kinds = [c.type for c in batch.columns[:-1]]
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                at = 0
                for rows in book.read(part.columns[-1].to_pylist()):
                    met = np.concatenate([np.zeros(0, np.int64), *(r for r in rows if r is not None)])
                    seen = np.bincount(met, minlength=len(book.texts)) + np.pad(seen, (0, len(book.texts) - len(seen)))
                    own = [c.slice(at, len(rows)) for c in part.columns[:-1]]
                    none = pa.nulls(len(rows), pa.struct(list(_PAIR)))
                    yield pa.RecordBatch.from_arrays([*own, _documents(book, rows), none], names=names)
                    at += len(rows)
                if book.full():
                    yield counted(book, seen, kinds)
                    book.forget(seen)
                    seen = np.zeros(0, np.int64)
        if seen.any():
            yield counted(book, seen, kinds)

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def _documents_kind() -> pa.DataType:
    lists = [(n, pa.list_(pa.int64())) for n in ("keys", "times")]
    return pa.struct([*((n, pa.int64()) for n in _NUMBERS), ("groups_sha256", pa.string()), *lists])


def all_pairs(met: DataFrame, same: np.ndarray) -> DataFrame:
    """a, b, how many links hold the pair, is it b's best; ``met`` has the tasks' counts.

    The vector comes from each task's own, added up; only links of irregular groups are shuffled
    by pair, one row a task and pair.
    """
    spark = met.sparkSession
    vector = met.filter("b is null").groupBy("a").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    along = [(r["a"], int(same[r["a"]]), r["n"]) for r in vector]
    pairs = met.filter("b is not null").union(spark.createDataFrame(along, "a int, b int, n long"))
    pairs = stage(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    top = F.broadcast(pairs.groupBy("b").agg(F.max("n").alias("top")))  # at most the other vocabulary
    return pairs.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _table(pairs: DataFrame, width: int, size: int) -> tuple[tuple, DataFrame | None]:
    """At most ``size`` pairs, the most frequent, as sorted keys, counts and marks; and the pairs left over."""
    level = F.floor(F.log2("n") * 4).cast("int")
    total, cut = 0, None
    for r in pairs.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 4 x 64 levels
        if (total := total + r["count"]) > size:
            break
        cut = r["level"]
    kept = pairs.filter(level >= cut) if cut is not None else pairs.limit(0)
    kept = kept.select((F.col("a").cast("long") * width + F.col("b")).alias("key"), "n", "best").toArrow()
    order = np.argsort(kept["key"].to_numpy())
    table = tuple(kept[c].to_numpy()[order].astype(np.int64) for c in ("key", "n", "best"))
    return table, None if total <= size else pairs if cut is None else pairs.filter(level < cut)


_SCORE = pa.struct(
    [("n_best", pa.int64()), ("count_sum", pa.int64())]
    + [("rare", pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())])))]
)


def _score(links: pa.StructArray, table: tuple) -> pa.Array:
    """Of documents' links: how many are of a best pair, the sum of their pairs' counts, those not in the table."""
    known, n, best = table
    sizes = np.array(links.field("keys").value_lengths().fill_null(0), np.int64)
    keys, times = (np.array(links.field(f).flatten(), np.int64) for f in ("keys", "times"))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    there = known[at] == keys if len(known) else np.zeros(len(keys), bool)
    sums = np.zeros((len(sizes), 2), np.int64)
    hit = at[there]
    np.add.at(sums, doc[there], np.column_stack([best[hit] * times[there], n[hit] * times[there]]))
    rare: list[list] = [[] for _ in sizes]
    for d, k, x in zip(doc[~there].tolist(), keys[~there].tolist(), times[~there].tolist()):
        rare[d].append({"key": k, "times": x})
    return pa.StructArray.from_arrays([pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(rare, _SCORE[2].type)], fields=list(_SCORE))


def aligned(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    text: str = "text",
    keep: tuple = ("doc_id",),
    out: str = "alignment",
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``out`` on how two tokenizers cut each whole text.

    ``path_a`` names byte-level BPE, which encodes a blank and the text, ``path_b`` a
    sentencepiece model, which adds the blank itself; special tokens' strings are plain text.
    ``n_a`` and ``n_b`` count tokens, ``n_groups`` the groups between two common ends, ``n_links``
    pairs of tokens that share bytes, ``n_best`` links of a pair that is its second id's most
    frequent in the corpus, ties included; ``count_sum`` adds up the corpus-wide counts of the
    links' pairs; ``groups_sha256`` is of the groups as text. Null and empty texts, and those
    that a tokenizer does not give back byte for byte, have zeros and an empty digest and take no
    part. Every row counts, repeated ones again; other columns are not looked at, and a kept
    one named ``out`` is replaced. An empty table gives an empty one. Both files must be there
    on every machine.
    """
    spark = docs.sparkSession
    aligner = Aligner(path_a, path_b)
    keep = tuple(k for k in keep if k.lower() != out.lower())
    made, pair, row, scored = (spare_name(docs, f"__{n}") for n in ("aligned", "pair", "row", "scored"))
    both = stage(align_documents(docs, path_a, path_b, text, keep, made, pair), "aligned")
    width = len(aligner.bytes_b)
    pairs = all_pairs(both.filter(F.col(pair).isNotNull()).select(f"{pair}.*"), aligner.same)
    table, rest = _table(pairs, width, table_size)
    shared = spark.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for links in batches:
            yield _score(links, shared.value)

    kind = "struct<n_best:long,count_sum:long,rare:array<struct<key:long,times:long>>>"
    m = F.col(made)
    done = both.filter(F.col(pair).isNull()).withColumn(
        scored, F.arrow_udf(score, kind)(F.struct(m["keys"].alias("keys"), m["times"].alias("times")))
    )
    s = F.col(scored)
    numbers = [m[n].alias(n) for n in _NUMBERS]
    digest = m["groups_sha256"].alias("groups_sha256")
    if rest is None:
        return done.select(*keep, F.struct(*numbers, s["n_best"].alias("n_best"), s["count_sum"].alias("count_sum"), digest).alias(out))
    done = stage(done.select(*keep, F.struct(*numbers, digest).alias(made), scored, F.monotonically_increasing_id().alias(row)), "scored")
    links = done.select(F.col(row).alias("row"), F.explode(s["rare"]).alias("link"))
    a = F.floor(F.col("link.key") / width).cast("int")
    links = links.select("row", a.alias("a"), (F.col("link.key") % width).cast("int").alias("b"), "link.times")
    more = (
        links.join(rest, ["a", "b"])
        .groupBy(F.col("row").alias(row))
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    )
    more = more.select(row, F.struct("more_best", "more").alias(pair))
    n_best = s["n_best"] + F.coalesce(F.col(pair)["more_best"], F.lit(0))
    count_sum = s["count_sum"] + F.coalesce(F.col(pair)["more"], F.lit(0))
    joined = done.join(more, row, "left")
    return joined.select(*keep, F.struct(*numbers, n_best.alias("n_best"), count_sum.alias("count_sum"), digest).alias(out))
