"""Operators on whole texts against brute force, with awkward rows and empty tables."""

import bisect
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from oracle import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dailycast.llm import (
    best_fit,
    catalog,
    decontaminate,
    labelled,
    line_runs,
    passage_quality,
    pivot_simhash,
    suffix_lm,
    token_counts,
    toxic_segments,
)

ROOT = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, __row long, __batch string, contamination string, n_tokens int, length int, n double"
LONG = " ".join(f"word{i % 977} Tail{i % 13}," for i in range(40_000))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    texts = [None, "", " ", "\n", "one", "One  two\tthree\n", "a b c d", "a b c d", "x\nboiler  plate\ny", "<|endoftext|> z",
             "\xa0\x1cé İ", LONG, LONG] + [f"line {i}\nBoiler  Plate " for i in range(12)]
    rows = [(None if i == 4 else i // 2 if i in (6, 7) else i, t, 1, "b", "c", 2, None, 0.5) for i, t in enumerate(texts)]
    rows.append(rows[-1])
    path = str(tmp_path_factory.mktemp("docs") / "docs.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def db():
    return connect(ROOT)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]


def same(a, b):
    return Counter(map(tuple, a)) == Counter(map(tuple, b))


# token counts


def test_token_counts_equal_the_library(spark, awkward):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_counts.token_counts(awkward, path).select("text", "n_tokens").distinct().collect()
    assert all(r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False)) for r in got)
    got = catalog.QUERIES["op1_token_counts"](spark, ROOT).collect()
    want = [
        (i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False)), n > 1024) for i, x in documents(spark)
    ]
    assert same(got, want)


def test_token_counts_of_odd_white_space(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 50)  # the cache starts anew again and again
    rng = random.Random(3)
    bits = [" ", " ", "  ", "\n", "\t", "a", "the", "!", "12", "é", "\xa0", "\x1c", " ", "<|endoftext|>", "'s", "日本", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    got = token_counts.PieceLengths(path, ["a", "the"]).counts(texts)
    assert got == [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_no_rows(nothing):
    out = token_counts.token_counts(nothing, public_tokenizers.path("byte_bpe_50k.json"))
    assert out.count() == 0 and set(out.columns) == set(nothing.columns)


def test_token_counts_refuse_a_tokenizer_that_cannot_be_cut(nothing):
    with pytest.raises(ValueError):
        token_counts.token_counts(nothing, public_tokenizers.path("word_bpe_49k.json"))


# decontamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, items, width=13):
    windows: dict = {}
    for name, text in items:
        w = WORD.findall((text or "").encode().lower())
        for j in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + width]), set()).add("" if name is None else str(name))
    for i, text in docs:
        w = WORD.findall((text or "").encode().lower())
        hit, names = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if found := windows.get(tuple(w[j : j + n])):
                    names |= found
                    hit.update(range(j, j + n))
        yield (i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
               bool(hit) and 20 * len(hit) >= len(w))


def test_decontamination_equals_brute_force(spark):
    items = spark.read.parquet(f"{ROOT}/benchmark.parquet").select("item_id", "text").collect()
    got = catalog.QUERIES["op6_decontamination"](spark, ROOT).collect()
    assert same(got, contaminated(documents(spark), items))


def test_decontamination_in_blocks_with_short_null_and_repeated_items(spark, awkward, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    monkeypatch.setattr(decontaminate, "BLOCKS_A_PASS", 2)
    items = [(1, "word5 tail5 word6 tail6"), (2, "one two three"), (2, "b c"), (None, "a b"), (3, None), (4, "..."), (5, "B C D")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(awkward, bench, window=3, out="hits", block_words=2)
    got = found.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").alias("k"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("h"), decontaminate.contaminated(F.col("hits")).alias("c"),
    )
    want = contaminated([(r["doc_id"], r["text"]) for r in awkward.collect()], items, 3)
    assert same(got.collect(), want)
    kept = decontaminate.decontaminate(awkward, bench, window=3)
    assert kept.columns == awkward.columns and kept.count() == got.filter("not c").count()


def test_longest_matches_have_their_places(spark):
    docs = spark.createDataFrame([(1, "u v a b c d e w"), (2, "c d e a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "z a b c d e y")], "item_id string, text string")
    out = decontaminate.find_contamination(docs, bench, window=3)
    got = {r["doc_id"]: sorted((m["doc_word"], m["item_word"], m["length"]) for m in r["contamination"]["matches"]) for r in out.collect()}
    assert got == {1: [(2, 1, 5)], 2: [(0, 3, 3), (3, 1, 3)]}


def maximal(words, items, width):
    """Every pair of places from which at least ``width`` words agree and the words before differ."""
    for k, item in enumerate(items):
        for i in range(len(words)):
            for j in range(len(item)):
                n = 0
                while i + n < len(words) and j + n < len(item) and words[i + n] == item[j + n]:
                    n += 1
                fresh = not i or not j or words[i - 1] != item[j - 1]
                if fresh and n >= min(width, len(item)):
                    yield i, k, j, n


@pytest.mark.parametrize("seed", range(12))
def test_matches_of_repetitive_words_are_the_maximal_ones(seed):
    rng = np.random.default_rng(seed)
    draw = lambda n: [b"ab"[i : i + 1] for i in rng.integers(0, 2, n)]
    items = [draw(int(n)) for n in rng.integers(1, 12, 5)] + [[b"a"] * 9, [b"a", b"b"] * 5]
    docs = [draw(25), [b"a"] * 14, [b"a", b"b"] * 8 + [b"c"] + [b"b", b"a"] * 3, []]
    tests = decontaminate.TestSuffixes([(str(k), b" ".join(w)) for k, w in enumerate(items)], 4)
    _, found = decontaminate.find_matches([b" ".join(d) for d in docs], tests)
    for doc, got in zip(docs, found):
        got = sorted((m["doc_word"], int(m["item_id"]), m["item_word"], m["length"]) for m in got)
        assert got == sorted(maximal(doc, items, 4))


@pytest.mark.parametrize("seed", range(6))
def test_matches_among_many_words_that_end_anywhere(seed):
    """Word numbers too wide for one key, windows that differ late, passages cut by other words."""
    rng = np.random.default_rng(seed)
    draw = lambda n: [b"w%d" % i for i in rng.integers(0, 3_000, n)]
    head = draw(8)
    items = [head[: int(rng.integers(0, 9))] + draw(int(n)) for n in rng.integers(13, 30, 8)] + [draw(3_000)]
    if seed % 2:
        items += [head[:3], head[:7] + draw(2)]
    docs = []
    for _ in range(12):
        doc = []
        for k in rng.integers(0, len(items), 4):
            at = int(rng.integers(0, max(1, len(items[k]) - 12)))
            doc += items[k][at : at + int(rng.integers(8, 20))] + [b"other"] * int(rng.integers(0, 3))
        docs.append(doc)
    tests = decontaminate.TestSuffixes([(str(k), b" ".join(w)) for k, w in enumerate(items)], 13)
    _, found = decontaminate.find_matches([b" ".join(d) for d in docs], tests)
    assert any(found)
    for doc, got in zip(docs, found):
        got = sorted((m["doc_word"], int(m["item_id"]), m["item_word"], m["length"]) for m in got)
        assert got == sorted(maximal(doc, items, 13))


@pytest.mark.parametrize("least, depth, words", [(13, 13, 3_000), (12, 13, 70_000), (40, 40, 900)])
def test_suffixes_are_sorted_by_all_their_words(least, depth, words):
    """Passages of equal beginnings, told apart by their last words only, where no suffix begins."""
    rng = np.random.default_rng(words)
    head = rng.integers(1, words, least - 3)
    ids = np.concatenate([np.r_[head, rng.integers(1, words, 3), 0] for _ in range(50)]).astype(np.int32)
    where = np.arange(0, len(ids), least + 1)
    padded = ids.tolist() + [0] * depth
    got = [padded[i : i + depth] for i in decontaminate.suffix_array(ids, where, depth)]
    assert got == sorted(padded[i : i + depth] for i in where)


def test_one_word_repeated_thousands_of_times():
    """Matches follow the diagonals (22,000 of them), not the pairs of windows (40 million)."""
    tests = decontaminate.TestSuffixes([("q", b"a " * 2_000)], 13)
    tracemalloc.start()
    counts, found = decontaminate.find_matches([b"a " * 20_000], tests)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts == [20_000] and len(found[0]) == 20_000 + 2_000 - 2 * 13 + 1
    assert max(m["length"] for m in found[0]) == 2_000 and peak < 100 << 20


def test_decontamination_of_nothing(spark, awkward, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(awkward, none).filter("contamination.n_hit > 0").count() == 0
    assert decontaminate.find_contamination(nothing, none).count() == 0


# line dedup


def test_line_dedup_equals_sql(spark, db):
    name = "op9_line_dedup"
    assert compare(spark, db, ROOT, catalog.QUERIES[name], catalog.ORACLES[name]) is None


@pytest.mark.parametrize("keys", [0, 100])
def test_lines_go_by_table_and_by_join(awkward, keys):
    out = line_runs.drop_common_lines(awkward, broadcast_keys=keys)
    strip = lambda line: line.strip(" \t\n\r\x0b\x0c").lower()
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    seen = Counter(k for _, t in rows for k in {strip(x) for x in t.split("\n")} if k)
    gone = {k for k, n in seen.items() if n >= 10}
    want = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if strip(x) not in gone]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert same(out.select("doc_id", "line_dedup.*").collect(), want) and gone


def test_runs_are_levelled_and_a_closed_key_is_not_counted_again(spark):
    runs = line_runs.LineRuns(spark, limit=3)
    batches = [[(1, 1)] * 3 + [(2, 2)], [(1, 1), (2, 2)], [(2, 2), (4, 4)], [(4, 4)], [(5, 5)]]
    for rows in batches:
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {tuple(r) for r in runs.common().collect()} == {(1, 1), (2, 2)}
    counts = {r["h1"]: r["n_docs"] for r in runs._total([n for x in runs.levels for n in x]).collect()}
    assert counts == {1: 3, 2: 3, 4: 2, 5: 1}


def test_line_dedup_of_no_rows(nothing):
    assert line_runs.drop_common_lines(nothing).count() == 0


# SimHash


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints: dict, bits=2):
    """Least id reachable, by comparing everything with everything."""
    ids = sorted(prints)
    x = np.array([prints[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_simhash_equals_brute_force(spark):
    docs = documents(spark)
    prints = {i: simhash(t) for i, t in docs}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in catalog.QUERIES["op5_simhash_dedup"](spark, ROOT).collect()}
    assert got == {i: (f"{prints[i]:016x}", c) for i, c in grouped(prints).items()}


def test_crowded_cells_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(pivot_simhash, "CELL", 4)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(30)}
    centre = rng.getrandbits(64)
    for _ in range(150):  # a large group of near copies
        x = centre
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(12)
        prints.add(x)
    signed = {int(np.uint64(p).astype(np.int64)): p for p in prints}
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    links = pivot_simhash.near_links(frame, 2)
    roots = {r["node"]: r["root"] for r in pivot_simhash.components(links).collect()}
    assert {p: roots.get(p, p) for p in signed} == grouped(signed)


def test_block_codes_tell_blocks_apart():
    table = pivot_simhash.PivotTable(2)
    x = np.arange(1 << 16, dtype=np.uint64) << np.uint64(16)
    assert len(np.unique(table.block_code(x, np.arange(16, 32)))) == 1 << 16
    other = x ^ (np.uint64(1) << np.uint64(40))
    assert (table.block_code(x, np.arange(16, 32)) == table.block_code(other, np.arange(16, 32))).all()


def test_near_copies_leave_one_row(awkward, nothing):
    kept = pivot_simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    found = pivot_simhash.near_duplicates(awkward).select("component").distinct().count()
    assert kept.count() == found < awkward.count()
    assert pivot_simhash.drop_near_duplicates(nothing).count() == 0


# language model


def test_tree_is_a_distribution(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the cat sat", "a dog ran", "the dog sat"]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    tree, _ = suffix_lm.fit_tree(spark.createDataFrame([(t,) for t in texts], "text string"))
    words = [b"the", b"cat", b"sat", b"a", b"dog", b"ran", suffix_lm.END]
    assert any((p < 1).any() for p in tree.passed[0:1]) and any((p < 1).any() for p in tree.passed[1:])
    for before in ([b"the"], [b"a", b"dog"], [b"the", b"cat"], [b"never"]):
        total = 0.0
        for w in words:
            p, known = tree.probability(tree.word_ids([*before, w]))
            total += p[-1]
        p, known = tree.probability(tree.word_ids([*before, b"unseen"]))
        assert not known[-1]
        total += p[-1] / (tree.total + tree.distinct + 1)
        assert total == pytest.approx(1, abs=1e-9)
    seen, _ = tree.probability(tree.word_ids([b"the", b"cat"]))
    assert seen[-1] > 2 * tree.root[tree.word_ids([b"cat"])[0]]


def test_lm_scores_have_the_contract_s_base(spark):
    docs = documents(spark)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in docs}
    c = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = catalog.QUERIES["op2_lm_scores"](spark, ROOT).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held(r["doc_id"]), len(ws), sum(w in c for w in ws), n)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_of_awkward_and_no_rows(awkward, nothing):
    out = suffix_lm.score_documents(awkward, F.lit(True))
    assert out.count() == awkward.count() and out.filter("score is null or score > 0 or isnan(score)").count() == 0
    assert suffix_lm.score_documents(awkward, F.lit(False)).filter("train_tokens = 0").count() == awkward.count()
    assert suffix_lm.score_documents(nothing, F.lit(True)).count() == 0


# classifiers


@pytest.mark.parametrize("name, column, share", [("op3_quality", "quality", 0.97), ("op7_toxicity", "toxic", 0.93)])
def test_classifiers_on_held_out_labels(spark, name, column, share):
    root = "/root/testdata/sf0.01"
    scored = catalog.QUERIES[name](spark, root)
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", column)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r[column] for r in rows) >= share * len(rows)
    assert scored.count() == 1000 and scored.filter("score < 0 or score > 1 or score is null").count() == 0


def test_a_repeated_id_does_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(i % 2, f"text {i % 900}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (5, 1)], "doc_id long, label int")
    seen = lambda texts, marks: f"{len(texts)} {len(set(texts))} {sum(map(len, texts))}".encode()
    assert labelled.fit_on_sample(docs, labels, seen, 3).split()[:2] == [b"3", b"3"]
    assert labelled.fit_on_sample(docs, labels, seen, 2000).split()[:2] == [b"900", b"900"]
    assert int(labelled.fit_on_sample(docs, labels, seen, 2000, text_bytes=100).split()[2]) <= 100


def test_classifiers_with_awkward_rows_and_few_labels(spark, awkward, nothing):
    kind = "doc_id long, label int"
    some = spark.createDataFrame([(0, 1), (None, 1), (3, None), (1, 0), (1, 0), (11, 1)], kind)
    one_class, none = spark.createDataFrame([(0, 1)], kind), spark.createDataFrame([], kind)
    for labels in (some, one_class, none):
        for score, out in ((passage_quality.score_quality, "score"), (toxic_segments.score_toxicity, "toxicity.score")):
            rows = score(awkward, labels).select(F.col(out).alias("s")).collect()
            assert len(rows) == awkward.count() and all(0 <= r["s"] <= 1 for r in rows)
            assert score(nothing, labels).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(2)
    texts = [b"aa bb cc", b"xx !! ?? xx xx", b""]
    m = __import__("pickle").loads(passage_quality.fit_model(texts, [1, 1, 1]))
    m = {k: rng.normal(0, 0.3, x.shape) for k, x in m.items()}
    codes = passage_quality.WordCodes()
    bags, y = passage_quality.Bags([passage_quality.encode(t * 40, codes) for t in texts]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = passage_quality.forward(m, bags)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = passage_quality._gradients(m, bags, passage_quality.forward(m, bags), y)
    for k in ("u", "v", "w", "out", "bias", "repeat", "offset", "word", "shape"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        kept = m[k][at]
        m[k][at] = kept + 1e-4
        up = loss()
        m[k][at] = kept - 1e-4
        down = loss()
        m[k][at] = kept
        assert g[k][at] == pytest.approx((up - down) / 2e-4, rel=2e-2)


def test_passages_of_equal_score_are_told_apart_by_their_words():
    scores = np.array([9.0, -30.0, 9.0, -30.0, 9.0])
    one = toxic_segments.evidence(np.array([1, 0, 1, 0, 1]), scores, 1.0, 0.1)
    three = toxic_segments.evidence(np.array([1, 0, 2, 0, 3]), scores, 1.0, 0.1)
    assert len(one[0]) == len(three[0]) == 3 and three[1][2] == pytest.approx(np.log1p(3 * np.expm1(one[1][2])))


def test_segments_are_the_maximal_ones():
    def brute(x, first=0):
        """The best segment, shortest first, then the same left and right of it."""
        best, at = 0.0, None
        for i in range(len(x)):
            for j in range(i, len(x)):
                s = sum(x[i : j + 1])
                if s > best + 1e-9 or (at and abs(s - best) <= 1e-9 and j - i < at[1] - at[0]):
                    best, at = s, (i, j)
        if at is None:
            return []
        i, j = at
        return brute(x[:i], first) + [(first + i, first + j, round(best, 6))] + brute(x[j + 1 :], first + j + 1)

    rng = random.Random(4)
    for _ in range(300):
        x = [rng.choice([-3.1, -1.7, -0.9, 0.8, 1.3, 2.6]) * rng.random() for _ in range(rng.randint(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in toxic_segments.segments(np.array(x))]
        total = sum(s for *_, s in brute(x))
        assert got == brute(x) or sum(s for *_, s in got) == pytest.approx(total, abs=1e-5)


# packing


def check_packing(rows, capacity):
    ends: dict = {}
    for seq, at, n in sorted(rows):
        assert at == ends.get(seq, 0)
        ends[seq] = at + n
        assert ends[seq] <= capacity
    assert set(ends) == set(range(len(ends)))
    return len(ends)


def test_pieces_are_the_library_s_and_packed_without_gaps(spark, awkward):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    pieces = best_fit.document_pieces(awkward, path, keep=("doc_id", "text"))
    ids: dict = {}
    for r in sorted(pieces.distinct().collect(), key=lambda r: (r["text"] or "", r["piece"], str(r["doc_id"]))):
        raw = np.frombuffer(r["ids"], "<u4")
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == 2048 * r["piece"] and len(raw) == r["length"]
        ids.setdefault((r["doc_id"], r["text"]), []).extend(raw.tolist())
    for (_, text), got in ids.items():
        assert got == t.encode(text or "", add_special_tokens=False).ids + [0]
    out = best_fit.pack(pieces.drop("ids"))
    rows = [(r["sequence_id"], r["offset"], r["length"]) for r in out.collect()]
    assert len(rows) == pieces.count()
    check_packing(rows, 2048)


def best_fit_decreasing(sizes, capacity):
    """Sequences that best fit opens when pieces come one at a time, longest first."""
    gaps, opened = [], 0
    for n in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, n)
        free = gaps.pop(at) if at < len(gaps) else capacity
        opened += free == capacity
        if free > n:
            bisect.insort(gaps, free - n)
    return opened


def swept(sizes, capacity):
    """Sequences and supersteps of the sweeps alone."""
    left = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    placed, gaps, opened, steps = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64), 0, 0
    while left.any():
        step = best_fit.Sweep(left, placed, gaps, opened)
        assert not step.left[step.low + 1 :].any()  # what is longer than the band has a place
        left, placed, gaps, opened, steps = step.left, step.placed, step.gaps, step.opened, steps + 1
    return opened, steps


def test_sweeps_open_as_many_sequences_as_best_fit_decreasing():
    rng = np.random.default_rng(3)
    mixes = [
        rng.integers(500, 1100, 8000),
        rng.integers(500, 800, 8000),
        np.clip(rng.lognormal(5.5, 1, 8000), 1, 2048).astype(int),
        rng.integers(1, 2049, 8000),
        rng.integers(1, 60, 8000),
        np.full(999, 700),
    ]
    for sizes in mixes:
        opened, steps = swept(sizes, 2048)
        assert opened <= 1.002 * best_fit_decreasing(sizes.tolist(), 2048) and steps <= 25


def test_packing_opens_no_more_than_best_fit_whatever_columns_are_called(spark):
    rng = random.Random(8)
    sizes = [rng.randint(1, 100) for _ in range(500)] + [7] * 300 + [100] * 5 + [51] * 20
    names = ("__rank", "offset", "seq", "__nth", "row", "lo", "place", "__part", "__size", "__shift", "a")
    schema = "length int, " + ", ".join(f"`{n}` int" for n in names)
    frame = spark.createDataFrame([(s, *range(i, i + len(names))) for i, s in enumerate(sizes)], schema)
    out = best_fit.pack(frame, capacity=100)
    assert sorted(out.columns) == sorted([*frame.columns, "sequence_id"])
    rows = out.collect()
    for r in rows:
        assert r["length"] == sizes[r["__rank"]]
        assert all(r[n] == r["__rank"] + i for i, n in enumerate(names) if n != "offset")
    packed = [(r["sequence_id"], r["offset"], r["length"]) for r in rows]
    assert Counter(r[2] for r in packed) == Counter(sizes)
    assert check_packing(packed, 100) <= best_fit_decreasing(sizes, 100) + 1


def test_op10_packing_holds_the_library_s_ids_of_every_document(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    want, sizes = {}, []
    for d in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[d["doc_id"], k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
            sizes.append(len(part))
    rows = catalog.op10_packing(spark, ROOT).collect()
    assert len(rows) == len(want)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    opened = check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
    assert opened <= best_fit_decreasing(sizes, 2048) + 1


def test_packing_refuses_what_fits_nowhere_and_takes_nothing(spark):
    with pytest.raises(ValueError):
        best_fit.pack(spark.createDataFrame([(2049,)], "length int"))
    out = best_fit.pack(spark.createDataFrame([], "length int"))
    assert out.count() == 0 and out.columns == ["length", "sequence_id", "offset"]
