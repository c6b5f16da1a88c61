"""Streaming BPE, token alignment and vector codes against the libraries and brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dailycast.llm import bpe_stream, catalog, part_codes, token_alignment

ROOT = "/root/testdata/sf0.001"
WORDS, BYTES, PIECES = (
    public_tokenizers.path(p) for p in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")
)
LONG = " ".join(f"word{i % 977} Tail{i % 13}," for i in range(4_000))
UNBROKEN = "".join(random.Random(5).choice("etaoinshrdlu") for _ in range(9_000))
TEXTS = [None, "", " ", "\n", "one", "One  two\tthree\n", "a b", "a b", "x <|endoftext|>y</s><s> z", "\xa0\x1cé İ ﬁ ½",
         "  lead and trail  ", "▁ odd", "日本 語 😀\x00", "it's 12,345 ... é", LONG, UNBROKEN, " a\n \nb  c"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rows = [(None if i == 3 else i // 2 if i in (6, 7) else i, t, 1, "x", 2.0) for i, t in enumerate(TEXTS)]
    path = str(tmp_path_factory.mktemp("texts") / "t.parquet")
    frame = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, __row long, alignment string, n double")
    frame.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]


# streaming BPE


def toy(merges):
    """Rules over letters a, b, c; each token is its own string."""
    strings = ["a", "b", "c", *dict.fromkeys(u + v for u, v in merges)]
    number = {s: k for k, s in enumerate(strings)}
    letters = {k: len(s) for k, s in enumerate(strings)}
    return bpe_stream.Rules([(number[u], number[v], number[u + v]) for u, v in merges], letters), letters


def by_rank(rules, ids):
    for (u, v), r in sorted(rules.rank.items(), key=lambda x: x[1]):
        i, out = 0, []
        while i < len(ids):
            pair = i + 1 < len(ids) and (ids[i], ids[i + 1]) == (u, v)
            out.append(int(rules.made[r]) if pair else ids[i])
            i += 2 if pair else 1
        ids = out
    return ids


def test_lookahead_is_sufficient(monkeypatch):
    """Random merge lists: all three ways of merging agree, and what the transducer has emitted never changes."""
    rng = random.Random(1)
    monkeypatch.setattr(bpe_stream, "BLOCK", 1)
    for _ in range(150):
        known, merges = ["a", "b", "c"], []
        for _ in range(rng.randint(1, 9)):
            pair = (rng.choice(known), rng.choice(known))
            if "".join(pair) not in known and pair not in merges:
                merges.append(pair)
                known.append("".join(pair))
        rules, letters = toy(merges)
        for _ in range(10):
            ids = [rng.randrange(3) for _ in range(rng.randint(1, 90))]
            want = by_rank(rules, ids)
            assert rules.merge(list(ids)) == want
            got, counts = rules.merge_many(np.array(ids + ids), np.array([len(ids)] * 2))
            assert got.tolist() == want + want and counts.tolist() == [len(want)] * 2
            take = bpe_stream.Transducer(rules, letters)
            assert [*take.feed(ids), *take.close()] == want


def test_lookahead_of_a_known_list():
    # c may keep b from joining a later; b then leaves aab open: the reach is b and aab's a's
    rules, _ = toy([("b", "c"), ("a", "b"), ("a", "ab")])
    assert rules.lookahead == 3


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe_stream.Rules([(3, 0, 4), (0, 1, 3)], {0: 1, 1: 1, 3: 2, 4: 3})


def test_transducer_keeps_a_bounded_number_of_letters():
    words = bpe_stream.WordIds(WORDS)
    take = bpe_stream.Transducer(words.spec.rules, words.spec.letters)
    held = 0
    for x in take.feed(words.spec.inner[ord(c)] for c in UNBROKEN * 3):
        held = max(held, len(take.open))
    assert 0 < held <= take.full


def test_text_machine_holds_back_unfinished_characters():
    machine = bpe_stream.TextMachine({0: "日".encode()[:2], 1: b"x", 2: "日".encode()})
    assert machine.feed([2, 0]) == "日 " and machine.close() == "�"
    assert machine.feed([1]) + machine.feed([9]) + machine.feed([1]) + machine.close() == "x x"


def test_codec_equals_the_library(spark, texts):
    lib = Tokenizer.from_file(WORDS)
    rows = texts.select("text", "n", bpe_stream.encoded(F.col("text"), WORDS).alias("ids"))
    rows = rows.withColumn("back", bpe_stream.decoded(F.col("ids"), WORDS)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["back"] == lib.decode(want, skip_special_tokens=False)
    empty = texts.limit(0).select(bpe_stream.encoded(F.col("text"), WORDS).alias("ids"))
    assert empty.select(bpe_stream.decoded(F.col("ids"), WORDS)).collect() == []


def test_odd_words_equal_the_library():
    lib, words, rng = Tokenizer.from_file(WORDS), bpe_stream.WordIds(WORDS), random.Random(3)
    parts = ["a", "B", "é", "É", "İ", "Σ", "ẞ", "́", "1", "½", " ", "\x1c", "\x85", "\x00", "'s", "'LL", "<|endoftext|>",
             "<|endof", "東", "😀", "‍", "क", "्", "_", "…", "ǅ", "th", "ing", "﻿", "᠎", ",", "."]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    got = words.encode([s.encode() for s in some])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]


def test_op13_equals_the_library(spark):
    lib = Tokenizer.from_file(WORDS)
    want = []
    for k, t in documents(spark):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want.append((k, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = catalog.QUERIES["op13_bpe_codec"](spark, ROOT).collect()
    assert Counter(map(tuple, got)) == Counter(want)


# token alignment


def brute_alignment(rows):
    """Straight from the definition: whole texts through both libraries, links by byte ranges."""
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    byte = {c: k for k, c in enumerate(bpe_stream.byte_letters())}
    done, counts = [], Counter()
    for key, text in rows:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ra = [bytes(byte[c] for c in a.id_to_token(x)) for x in ia]
        rb = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ib for p in [b.id_to_piece(x)]]
        if not text or not b"".join(ra) == b"".join(rb) == (" " + text).encode():
            done.append((key, [], [], [], []))
            continue
        ea, eb = list(itertools.accumulate(map(len, ra))), list(itertools.accumulate(map(len, rb)))
        links, j = [], 0
        for i, end in enumerate(ea):
            while eb[j] <= end - len(ra[i]):
                j += 1
            k = j
            while k < len(eb) and eb[k] - len(rb[k]) < end:
                links.append((ia[i], ib[k]))
                k += 1
        groups, pa, pb = [], 0, 0
        at_a, at_b = ({end: k for k, end in enumerate(ends)} for ends in (ea, eb))
        for end in sorted(set(ea) & set(eb)):
            qa, qb = at_a[end] + 1, at_b[end] + 1
            groups.append(f"{','.join(map(str, ia[pa:qa]))}|{','.join(map(str, ib[pb:qb]))}")
            pa, pb = qa, qb
        counts.update(links)
        done.append((key, ia, ib, links, groups))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (key, len(ia), len(ib), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links),
         sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else "")
        for key, ia, ib, links, groups in done
    ]


@pytest.mark.parametrize("size", [token_alignment.TABLE_SIZE, 40, 0])
def test_alignment_equals_brute_force(spark, texts, size):
    got = token_alignment.aligned(texts, BYTES, PIECES, keep=("doc_id", "n"), table_size=size)
    want = brute_alignment([(r["doc_id"], r["text"]) for r in texts.select("doc_id", "text").collect()])
    assert Counter(map(tuple, got.select("doc_id", "alignment.*").collect())) == Counter(want)
    assert got.columns == ["doc_id", "n", "alignment"]


def test_pieces_forgotten_within_a_task_are_counted(spark, texts, monkeypatch):
    book = token_alignment.Book(token_alignment.Aligner(BYTES, PIECES))
    rows = list(book.read(["one two one"]))[0]
    counts = token_alignment._counts(book, np.bincount(rows[0], minlength=len(book.texts)))
    book.clear()
    again = list(book.read(["two one"]))[0]
    counts = counts.to_pylist() + token_alignment._counts(book, np.bincount(again[0])).to_pylist()
    total = Counter()
    for r in counts:
        total[r["a"], r["b"]] += r["n"]
    assert sorted(total.values()) == [2, 3] and all(b is None for _, b in total)


def test_cuts_are_where_both_tokenizers_break():
    """Random texts full of marks, line ends and white space: pieces one after the other give the ids of the whole."""
    rng, aligner = random.Random(3), token_alignment.Aligner(BYTES, PIECES)
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    some = [*"aZéßÿ×÷2.,!'\"-_*$(", *"  \n\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "’", "²",
            "日", "e\u0301", "😀", "\x00", "</s>", "the", " the", "'s", "'ll", ". The", "end.\nNext"]
    plain = [x for x in some if x.isascii()]
    for k in range(4_000):
        text = "".join(rng.choices(plain if k % 2 else some, k=rng.randint(1, 12)))
        pieces = aligner.cut(text)
        raw = [p[1:] if p[:1] == b"\xff" else b" " + p for p in pieces]
        assert b"".join(raw).decode() == " " + text
        ids_a, n_a = aligner.encode_a(raw)
        ids_b, n_b = aligner.encode_b(raw)
        assert ids_a.tolist() == a.encode(" " + text, add_special_tokens=False).ids and len(ids_a) == n_a.sum(), text
        assert ids_b.tolist() == b.encode(text) and len(ids_b) == n_b.sum(), text


def test_words_are_aligned_once_whatever_mark_or_line_end_follows():
    book = token_alignment.Book(token_alignment.Aligner(BYTES, PIECES))
    words = [f"w{'abcdefgh'[i]}{'éüßñ'[j]}" for i in range(8) for j in range(4)]
    text = " ".join(f"{w}{mark}" for mark in ("", ".", ",", "!!", "***", "?") for w in words)
    lines = "\n".join(f"{w} {v}." for w in words for v in words)
    list(book.read([text, lines]))
    assert len(book.texts) <= 2 * len(words) + 10  # with a blank before or first in a line, marks, the line end


def test_pieces_met_again_are_kept(monkeypatch):
    """Counts do not depend on what a worker forgets, and frequent pieces are not aligned twice."""
    rng, learned = random.Random(7), Counter()
    texts = [" ".join(["often.", f"rare{rng.random()}", "common", "naïve", *rng.choices(["x", "y,"], k=4)]) for _ in range(60)]

    def total(size):
        monkeypatch.setattr(token_alignment, "CACHE_SIZE", size)
        book, counts, docs, forgotten = token_alignment.Book(aligner), Counter(), [], 0
        learn = book.learn
        book.learn = lambda pieces: (learned.update(pieces), learn(pieces))
        seen = np.zeros(0, np.int64)
        for k, text in enumerate(texts):
            rows = next(book.read([text]))
            seen = np.bincount(rows[0], minlength=len(book.texts)) + np.pad(seen, (0, len(book.texts) - len(seen)))
            docs += token_alignment._documents(book, rows).to_pylist()
            if book.full() or k == len(texts) - 1:
                for r in token_alignment._counts(book, seen).to_pylist():
                    counts[r["a"], r["b"]] += r["n"]
                book.forget(seen)
                seen, forgotten = np.zeros(0, np.int64), forgotten + 1
        return counts, docs, forgotten

    aligner = token_alignment.Aligner(BYTES, PIECES)
    whole = total(10_000)
    learned.clear()
    some = total(20)
    assert whole[:2] == some[:2] and some[2] > 2
    assert learned[b"common"] == learned[b"often"] == 1


def test_op12_equals_brute_force(spark):
    got = catalog.QUERIES["op12_token_alignment"](spark, ROOT).collect()
    assert Counter(map(tuple, got)) == Counter(brute_alignment(documents(spark)))


def test_alignment_of_nothing(spark, texts):
    assert token_alignment.aligned(texts.limit(0), BYTES, PIECES).collect() == []


# vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Straight from the definition, in Python numbers. Rows: id, vector, label."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [[int(np.floor(4096 * float(x))) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, whole[i]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for c in cut:
                met.setdefault(nearest(p, c[p])[1], []).append(c[p])
            for k, some in met.items():
                books[p][k] = [sum(x) // len(some) for x in zip(*some)]
    out = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in o) for o in out]
    by_label = Counter()
    for r, e in zip(rows, errors):
        by_label[r[2]] += e
    return [(r[0], [k for _, k in o], e, by_label[r[2]]) for r, o, e in zip(rows, out, errors)], books


SCHEMA = "vec_id long, embedding array<float>, label int, __row string, __codes int, __total int, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, 2, "c") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n", [200, 9])
def test_codes_equal_brute_force(spark, n):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 16))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=16)).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    hot = [(n + i, rows[3][1], 1) for i in range(n // 2)]
    nan, inf = float("nan"), float("inf")
    odd = [(None, rows[1][1], 1), (None, rows[2][1], None), (500, None, 1), (501, [nan] * 16, 1), (502, [inf] + [0.0] * 15, 1),
           (503, [None] + [1.0] * 15, 1), (4, rows[4][1], 1), (4, rows[5][1], 1), (4, rows[5][1], 1), (5, [-0.0] * 16, 2)]
    frame = vectors(spark, rows + hot + odd)
    data = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    got, books = part_codes.compress(frame)
    want, want_books = brute_codes(data)
    assert books.tolist() == want_books
    flat = lambda rows: Counter((i, tuple(c), e, s) for i, c, e, s in rows)
    assert flat(got.select("vec_id", "code.entries", "code.error", "code.label_error").collect()) == flat(want)
    assert got.columns == ["vec_id", "label", "__row", "__codes", "__total", "code"]


def test_only_members_that_change_their_entry_are_moved(spark):
    rows = [(i, 0, [i], -1 if i < 3 else i % 2, i % 2, 0) for i in range(40)]
    written = spark.createDataFrame(rows, part_codes._MEMBER)
    plan = part_codes.residents(written, {(0, 0): 20, (0, 1): 20}, 4)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Union" in text
    before = written.filter("home = entry").rdd.getNumPartitions()
    assert plan.rdd.getNumPartitions() == before + 4 and plan.count() == 40


def test_large_entries_have_salts(spark, monkeypatch):
    monkeypatch.setattr(part_codes, "GROUP", 10)
    rows = [(i, 0, [i], -1, 0 if i < 900 else 1, 0) for i in range(1000)]
    dealt = part_codes.settle(spark.createDataFrame(rows, part_codes._MEMBER), {(0, 0): 900, (0, 1): 100}, 8)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 500


def test_codes_of_odd_tables(spark):
    got, books = part_codes.compress(vectors(spark, []))
    assert got.collect() == [] and books.size == 0
    got, _ = part_codes.compress(vectors(spark, [(1, None, 1)]))
    assert got.collect() == []
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(ValueError):
            part_codes.compress(vectors(spark, bad))
