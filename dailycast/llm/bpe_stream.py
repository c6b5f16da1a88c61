"""BPE encoding by a streaming transducer with bounded lookahead, and incremental decoding.

The merge list says how far a later letter can reach back: a token that ends that many
letters before the newest one read is settled, whatever follows. The transducer emits settled
tokens and keeps the rest, so its memory is bounded by the lookahead, however long a word is.
The decoder turns ids into bytes and feeds them to a UTF-8 state machine that holds back an
unfinished character from one block to the next.
"""

import codecs
import heapq
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from dailycast.llm.common import held, slices

#: Letters a transducer takes beyond the lookahead before it settles some.
BLOCK = 512
#: Words whose ids a worker remembers, and the longest of them in bytes.
CACHE_SIZE, WORD_BYTES = 300_000, 48
#: Bytes of text looked up together, and ids decoded in one step.
HELD, DECODED = 1 << 20, 65_536

_NONE = 1 << 60
#: Words of letters that neither normalizing nor pre-tokenizing changes, case apart.
#: A mark after them is a word of its own.
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbe])+([.,;:!?])?")


def byte_letters() -> list[str]:
    """The letters that byte-level models write bytes as: printable ones as they are."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Rules:
    """A merge list over token ids, ranked by its order, and the lookahead that it needs.

    ``merges`` are (left, right, made) and ``letters`` the number of letters of each token.
    """

    def __init__(self, merges: list[tuple[int, int, int]], letters: dict[int, int]):
        self.rank = {(u, v): r for r, (u, v, _) in enumerate(merges)}
        known = {t for t, n in letters.items() if n == 1}
        for u, v, t in merges:
            if u not in known or v not in known:
                raise ValueError("a merge comes before the tokens that it joins: no lookahead is sufficient")
            known.add(t)
        self.made = np.array([t for _, _, t in merges] or [0], np.int64)
        self.longest = max((letters[t] for t in known), default=1)
        self.lookahead = sufficient_lookahead(merges, letters)
        bits = max(4, (4 * len(merges)).bit_length())
        self.shift, self.key, self.at = np.uint64(64 - bits), np.full(1 << bits, -1), np.zeros(1 << bits, np.int64)
        keys = np.array([u << 32 | v for u, v in self.rank] or [0], np.int64)
        for key, slot, r in zip(keys.tolist(), self._slot(keys).tolist(), self.rank.values()):
            while self.key[slot] >= 0:
                slot = (slot + 1) % len(self.key)
            self.key[slot], self.at[slot] = key, r

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs, from a table with open addresses; pairs without a rule get ``_NONE``."""
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.at[slot], _NONE)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.key)
            found = self.key[slot[left]]
            same = found == keys[left]
            out[left[same]] = self.at[slot[left[same]]]
            left = left[~same & (found >= 0)]
        return out

    def merge_many(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many sequences that follow one another, and how many each has.

        In each round every sequence applies its rule of lowest rank, from the left.
        """
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_word, done_ids = [], []
        while len(ids):
            last = np.append(word[1:] != word[:-1], True)
            rank = np.full(len(ids), _NONE)
            inner = np.flatnonzero(~last)
            rank[inner] = self._ranks(ids[inner] << 32 | ids[inner + 1])
            starts = np.flatnonzero(np.append(True, last[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            over = best == _NONE
            done_word.append(word[over])
            done_ids.append(ids[over])
            hit = (rank == best) & ~over
            hit[1:] &= ~hit[:-1]
            ids = np.where(hit, self.made[np.where(hit, rank, 0)], ids)
            keep = ~over
            keep[1:] &= ~hit[:-1]
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return ids, np.zeros(len(sizes), np.int64)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(word, minlength=len(sizes))

    def merge(self, ids: list[int]) -> list[int]:
        """Tokens of one sequence: lowest rank first, ties from the left, by a heap over linked letters."""
        ids, n = list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self.rank, self.made
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = int(made[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (x, h))
        return [t for t in ids if t >= 0]


def sufficient_lookahead(merges: list[tuple[int, int, int]], letters: dict[int, int]) -> int:
    """Letters beyond a token's end after which nothing that follows can change it.

    Rules apply in the order of their ranks. What depends on letters not yet read begins at a
    frontier, at first behind the newest letter. Rule (u, v) moves it back by the letters of u,
    if u is the last token before it and v begins there; the next rule that can move it has a
    higher rank and a right side that begins with that u, itself or merged to the right. So the
    reach is the heaviest chain of such rules, found in one pass over the list.
    """
    firsts: dict[int, set[int]] = {}
    for u, _, t in merges:
        firsts.setdefault(t, set()).add(u)
    spines: dict[int, frozenset] = {}

    def spine(t: int) -> frozenset:
        """The tokens that t may have begun as."""
        if t not in spines:
            spines[t] = frozenset({t}).union(*(spine(u) for u in firsts.get(t, ())))
        return spines[t]

    reach: dict[int, int] = {}
    for u, v, _ in merges:
        far = letters[u] + max(reach.get(t, 0) for t in spine(v))
        reach[u] = max(reach.get(u, 0), far)
    return max(reach.values(), default=0)


class Transducer:
    """Reads the letters of one word in any portions and emits its tokens once they are settled."""

    def __init__(self, rules: Rules, letters: list[int]):
        self.rules, self.letters, self.open = rules, letters, []
        self.full = rules.lookahead + max(BLOCK, rules.longest)

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        for s in symbols:
            self.open.append(s)
            if len(self.open) >= self.full:
                yield from self._settle()

    def _settle(self) -> Iterator[int]:
        last, end = len(self.open) - self.rules.lookahead, 0
        for token in self.rules.merge(list(self.open)):
            n = self.letters[token]
            if end + n > last:
                break
            end += n
            yield token
        del self.open[:end]

    def close(self) -> list[int]:
        """The tokens of what is left; a new word may follow."""
        rest, self.open = self.rules.merge(self.open), []
        return rest


class Spec:
    """What a tokenizer file says, as far as it is read here: byte-level BPE over dropped white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = {p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in odd) or kinds != {"Split", "ByteLevel"}:
            raise ValueError("only byte-level BPE over words that a pattern finds can be read")
        if spec.get("decoder"):
            raise ValueError("only token strings, joined by blanks, are decoded")
        vocab, tail = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens must stand for their own strings")
        size = lambda t: len(t) - len(tail) if tail and t.endswith(tail) and len(t) > len(tail) else len(t)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.letters = {i: size(t) for t, i in vocab.items()}
        self.rules = Rules([(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs], self.letters)
        shown = byte_letters()
        self.byte = {c: b for b, c in enumerate(shown)}
        self.inner = [vocab[c] for c in shown]
        self.final = [vocab[c + tail] for c in shown]
        self.strings = {i: t.encode() for t, i in [*vocab.items(), *self.added.items()]}


class WordIds:
    """Ids of blank-separated words as little-endian 32-bit numbers, each from the transducer.

    A word shorter than the lookahead closes before any token of it is settled; such words are
    merged together, a block at a time. Longer ones stream.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.spec = Spec(path)
        self.inner, self.final = np.array(self.spec.inner, np.int64), np.array(self.spec.final, np.int64)
        marks = sorted(map(re.escape, self.spec.added), key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(marks) + ")") if marks else None

    def _parts(self, word: bytes) -> list:
        """The words of the model in a blank-separated one, and the ids of added tokens."""
        plain = _PLAIN.fullmatch(word)
        if plain:
            return [word.lower()] if not plain[1] else [word[:-1].lower(), plain[1]]
        out: list = []
        text = word.decode()
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.spec.added:
                out.append(self.spec.added[part])
            elif part:
                clean = self.normalizer.normalize_str(part) if self.normalizer else part
                out += [bytes(map(self.spec.byte.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(clean)]
        return out

    def _stream(self, raw: bytes) -> bytes:
        take = Transducer(self.spec.rules, self.spec.letters)
        out = list(take.feed(map(self.spec.inner.__getitem__, raw[:-1])))
        out += take.feed([self.spec.final[raw[-1]]])
        return np.array(out + take.close(), "<u4").tobytes()

    def _short(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        ids, ends = self.inner[raw], np.cumsum(sizes)
        ids[ends - 1] = self.final[raw[ends - 1]]
        ids, counts = self.spec.rules.merge_many(ids, sizes)
        whole, at = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(4 * counts)).tolist()
        return [whole[i:j] for i, j in zip(at, at[1:])]

    def learn(self, words: set[bytes]) -> None:
        parts = {w: self._parts(w) for w in words}
        new = {p for some in parts.values() for p in some if isinstance(p, bytes)}
        short = [p for p in new if len(p) <= self.spec.rules.lookahead]
        known = dict(zip(short, self._short(short)))
        known.update((p, self._stream(p)) for p in new if p not in known)
        for w, some in parts.items():
            if len(some) == 1 and isinstance(some[0], bytes):
                self.known[w] = known[some[0]]
                continue
            self.known[w] = b"".join([known[p] if isinstance(p, bytes) else np.array([p], "<u4").tobytes() for p in some])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts, a block of about ``HELD`` bytes at a time."""
        out: list[bytes] = []
        some: list[list[bytes]] = []
        size = 0
        for k, t in enumerate(texts):
            some.append(t.split())
            size += len(t)
            if size < HELD and k < len(texts) - 1:
                continue
            new = set().union(*some).difference(self.known)
            self.learn(new)
            out += [b"".join(map(self.known.__getitem__, words)) for words in some]
            if len(self.known) > CACHE_SIZE:
                self.known.clear()
            else:
                for w in new:
                    if len(w) > WORD_BYTES:
                        del self.known[w]
            some, size = [], 0
        return out


class TextMachine:
    """Ids to text in portions; bytes of an unfinished character wait for the next one."""

    def __init__(self, strings: dict[int, bytes]):
        self.strings, self.first = strings, True
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        parts = [s for i in ids if (s := self.strings.get(i)) is not None]
        if not parts:
            return ""
        lead, self.first = (b"" if self.first else b" "), False
        return self.decoder.decode(lead + b" ".join(parts))

    def close(self) -> str:
        rest = self.decoder.decode(b"", True)
        self.first = True
        return rest

    def text(self, raw: bytes) -> str:
        """A whole row of little-endian ids, a block at a time."""
        ids = np.frombuffer(raw, "<u4")
        blocks = [self.feed(ids[i : i + DECODED].tolist()) for i in range(0, len(ids), DECODED)]
        return "".join([*blocks, self.close()])


def encoded(text: Column, tokenizer_path: str) -> Column:
    """The ids of each whole text as little-endian unsigned 32-bit numbers, a binary column.

    Nothing is added or cut; an added token's string inside a text is that token, as is the
    library's default. Null and empty texts, and those of white space, have no ids (empty, not
    null). Rows are encoded by themselves, so repeats and ties need no care, and other columns
    are not looked at. The file must be at ``tokenizer_path`` on every machine; one whose
    merge list has no sufficient lookahead, or that keeps white space, is a ValueError.
    """
    return _transcoded(text, tokenizer_path, ("ids",))["ids"]


def decoded(ids: Column, tokenizer_path: str) -> Column:
    """The text of each row of little-endian 32-bit ids: token strings joined by blanks.

    Added tokens are shown, ids outside the vocabulary left out, bytes that are no UTF-8
    replaced. Null and empty rows give the empty text.
    """
    Spec(tokenizer_path)
    query = uuid.uuid4().hex

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = TextMachine(held((query,), lambda: Spec(tokenizer_path).strings))
        for rows in slices(batches):
            yield pa.array([machine.text(raw or b"") for raw in rows], pa.string())

    return F.arrow_udf(decode, "string")(ids)


def round_trip(text: Column, tokenizer_path: str) -> Column:
    """A struct of ``ids``, as ``encoded`` gives them, and ``text``, what ``decoded`` makes of those.

    One worker does both, so that ids do not travel between two.
    """
    return _transcoded(text, tokenizer_path, ("ids", "text"))


def _transcoded(text: Column, tokenizer_path: str, fields: tuple) -> Column:
    Spec(tokenizer_path)
    query = uuid.uuid4().hex
    kinds = {"ids": pa.binary(), "text": pa.string()}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = held((query,), lambda: WordIds(tokenizer_path))
        machine = TextMachine(words.spec.strings)
        for texts in slices(batches):
            ids = words.encode([(t or "").encode() for t in texts])
            columns = [ids] if fields == ("ids",) else [ids, [machine.text(raw) for raw in ids]]
            arrays = [pa.array(c, kinds[f]) for c, f in zip(columns, fields)]
            yield pa.StructArray.from_arrays(arrays, names=list(fields))

    schema = ",".join(f"{f}:{'binary' if f == 'ids' else 'string'}" for f in fields)
    return F.arrow_udf(run, f"struct<{schema}>")(text)
