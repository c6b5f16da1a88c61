"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded from hashed
words, word shapes and repeats; gated attention, learned from document labels alone, weighs
the passages; a logistic layer scores the weighted representation.
"""

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm.common import batch_texts
from dailycast.llm.labelled import fit_on_sample

#: Labelled documents the model is fitted on at most.
MAX_LABELLED = 3_000
#: Words of a passage; hash buckets of words and shapes; widths of encoding and attention.
PASSAGE, WORDS, SHAPES, WIDTH, GATE = 64, 4096, 128, 24, 16
EPOCHS, BATCH, RATE, DECAY = 10, 64, 0.02, 1e-5
#: Word codes a worker remembers.
CACHE_SIZE = 400_000

_ENDINGS = {c: 1 for c in b".,;:"} | {c: 2 for c in b"!?"} | {c: 3 for c in b"#$%&*+-/<=>@\\^_`{|}~"}


def _code(word: bytes) -> int:
    """A word's hash bucket and its shape: case, ending and length."""
    first = word[0]
    case = 0 if 0x61 <= first <= 0x7A else 1 if 0x41 <= first <= 0x5A else 2
    if len(word) > 1 and word.isupper():
        case = 3
    length = min(len(word).bit_length() - 1, 4)
    shape = (case * 4 + _ENDINGS.get(word[-1], 0)) * 5 + length
    return (zlib.crc32(word.lower()) % WORDS) * SHAPES + shape


class WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_SIZE:
            self.clear()
        code = _code(word)
        self[word] = code
        return code


def encode(text: bytes, codes: WordCodes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(codes.__getitem__, words), np.int32, len(words))


def passage_starts(n: int) -> np.ndarray:
    return np.arange(0, max(n, 1), PASSAGE)


class Bags:
    """Codes of some documents laid out flat, with their passages."""

    def __init__(self, docs: list[np.ndarray]):
        # an empty text is one passage of a single blank word, code 0
        docs = [d if len(d) else np.zeros(1, np.int32) for d in docs]
        sizes = np.array([len(d) for d in docs])
        self.codes = np.concatenate(docs)
        begin = np.cumsum(sizes) - sizes
        starts = [passage_starts(n) for n in sizes]
        self.passages = np.array([len(s) for s in starts])
        self.first = np.cumsum(self.passages) - self.passages
        self.start = np.concatenate([s + b for s, b in zip(starts, begin)])
        self.length = np.diff(np.append(self.start, len(self.codes))).astype(np.float32)
        self.doc = np.repeat(np.arange(len(docs)), self.passages)
        same = np.zeros((len(self.codes), 2), np.float32)
        for k in (1, 2):
            same[k:, k - 1] = self.codes[k:] == self.codes[:-k]
        self.repeats = np.add.reduceat(same, self.start) / self.length[:, None]


def forward(m: dict, bags: Bags) -> dict:
    rows = m["word"][bags.codes // SHAPES]
    rows += m["shape"][bags.codes % SHAPES]
    total = np.add.reduceat(rows, bags.start) / bags.length[:, None]
    h = np.tanh(total + bags.repeats @ m["repeat"] + m["bias"])
    u, v = np.tanh(h @ m["u"]), 1 / (1 + np.exp(-(h @ m["v"])))
    e = (u * v) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, bags.first)[bags.doc])
    a = e / np.add.reduceat(e, bags.first)[bags.doc]
    z = np.add.reduceat(a[:, None] * h, bags.first)
    p = 1 / (1 + np.exp(-np.clip(z @ m["out"] + m["offset"], -30, 30)))
    return {"h": h, "u": u, "v": v, "a": a, "z": z, "p": p}


def _gradients(m: dict, bags: Bags, f: dict, y: np.ndarray) -> dict:
    d = ((f["p"] - y) / len(y)).astype(np.float32)
    g = {"out": f["z"].T @ d, "offset": d.sum(keepdims=True)}
    dz = d[:, None] * m["out"]
    dh = f["a"][:, None] * dz[bags.doc]
    da = (f["h"] * dz[bags.doc]).sum(axis=1)
    mean = np.add.reduceat(f["a"] * da, bags.first)
    de = f["a"] * (da - mean[bags.doc])
    g["w"] = (f["u"] * f["v"]).T @ de
    gate = de[:, None] * m["w"]
    du, dv = gate * f["v"] * (1 - f["u"] ** 2), gate * f["u"] * f["v"] * (1 - f["v"])
    g["u"], g["v"] = f["h"].T @ du, f["h"].T @ dv
    dh += du @ m["u"].T + dv @ m["v"].T
    dt = dh * (1 - f["h"] ** 2)
    g["repeat"], g["bias"] = bags.repeats.T @ dt, dt.sum(axis=0)
    share = np.repeat(dt / bags.length[:, None], bags.length.astype(int), axis=0)
    for name, ids, size in (("word", bags.codes // SHAPES, WORDS), ("shape", bags.codes % SHAPES, SHAPES)):
        order = np.argsort(ids, kind="stable")
        groups = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
        full = np.zeros((size, WIDTH), np.float32)
        full[ids[order][groups]] = np.add.reduceat(share[order], groups)
        g[name] = full
    return g


def fit_model(texts: list[bytes], labels: list[int]) -> bytes:
    """Parameters fitted with Adam on document labels; a constant where one class is missing."""
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(0)
    shapes = {
        "word": (WORDS, WIDTH), "shape": (SHAPES, WIDTH), "repeat": (2, WIDTH), "bias": (WIDTH,),
        "u": (WIDTH, GATE), "v": (WIDTH, GATE), "w": (GATE,), "out": (WIDTH,), "offset": (1,),
    }
    m = {k: (rng.normal(0, 0.2, s) if len(s) > 1 or k in ("w", "out") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    m["word"] *= 0.1
    if len(set(labels)) < 2:
        m["out"][:] = 0
        m["offset"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return pickle.dumps(m)
    codes = WordCodes()
    docs = [encode(t, codes) for t in texts]
    first = {k: np.zeros_like(x) for k, x in m.items()}
    second = {k: np.zeros_like(x) for k, x in m.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(docs), BATCH):
            mine = order[i : i + BATCH]
            bags = Bags([docs[k] for k in mine])
            g = _gradients(m, bags, forward(m, bags), y[mine])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in m:
                grad = g[k] + DECAY * m[k]
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad**2 - second[k])
                m[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return pickle.dumps(m)


def score_texts(m: dict, texts: list[bytes], codes: WordCodes) -> np.ndarray:
    out, held, size = [], [], 0
    for text in texts:
        held.append(encode(text, codes))
        size += len(held[-1])
        if size > 200_000:
            out.append(forward(m, Bags(held))["p"])
            held, size = [], 0
    if held:
        out.append(forward(m, Bags(held))["p"])
    return np.concatenate(out) if out else np.zeros(0)


_WORKER: dict = {}


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    out: str = "score",
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text as a double ``out``.

    ``labels`` holds doc_id and label; the model is fitted on at most ``max_labelled`` of
    them (see ``fit_on_sample``) and reads nothing but texts. Null and empty texts are
    one blank passage and get a score like any other. Without labels, or with one class
    only, every score is the smoothed share of label 1. Equal texts get equal scores; rows
    keep their columns (``out`` is replaced).
    """
    model = fit_on_sample(docs, labels, fit_model, max_labelled, text, doc_id)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = (pickle.loads(shared.value), WordCodes())
        m, codes = _WORKER[key]
        for batch in batches:
            yield pa.array(score_texts(m, batch_texts(batch), codes).astype(np.float64))

    return docs.withColumn(out, F.arrow_udf(score, "double")(F.col(text)))
