"""Toxic passages as maximum-scoring segments of token log-odds.

A token's toxic share is a posterior mean under a chain of Dirichlet priors: a word's prior
is centred on the share of its prefix, that on a shorter prefix, down to the share of all
documents. Log-odds against that share, less a drift, make typical text score below zero;
a linear scan then finds every maximal scoring segment, and extreme-value theory says which
of them chance would not have made.
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
from dailycast.llm.decontaminate import split_words
from dailycast.llm.labelled import fit_on_sample

#: Labelled documents the model is fitted on at most.
MAX_LABELLED = 8_000
#: Bytes of the prefixes in the chain of priors, and hash buckets of each length.
PREFIXES, BUCKETS = (3, 4, 5, 6), 1 << 18
#: Strength of each prior in documents, what a token must exceed, and the largest log-odds.
PRIOR, DRIFT, CAP = 4.0, 1.5, 6.0
#: Chance segments expected in a document that still count as significant.
E_VALUE = 0.05
CACHE_SIZE = 400_000

SEGMENTS = "array<struct<first_word:int,last_word:int,score:double,e_value:double>>"


def features(word: bytes) -> list[int]:
    """Buckets of a word's prefixes, short to long, and of the word; a word too short has its own."""
    return [zlib.crc32(word[:k] if len(word) > k else word + b" ") % BUCKETS for k in (*PREFIXES, len(word))]


def log_odds(buckets: np.ndarray, m: dict, less: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Posterior log-odds of words given by rows of ``features``, less the drift.

    ``less`` takes one document of a class out of the counts, to score it unseen.
    """
    buckets = buckets.reshape(-1, len(PREFIXES) + 1)
    p = np.full(len(buckets), m["share"])
    for column in buckets.T:
        t = np.maximum(m["toxic"][column] - less[0], 0)
        c = np.maximum(m["clean"][column] - less[1], 0)
        p = (t + PRIOR * p) / (t + c + PRIOR)
    share = m["share"]
    return np.clip(np.log(p / (1 - p)) - np.log(share / (1 - share)), -CAP, CAP) - DRIFT


def token_scores(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Scores in text order; a word right after itself tells nothing new and costs the drift."""
    again = np.r_[False, words[1:] == words[:-1]] if len(words) else np.zeros(0, bool)
    return np.where(again, np.minimum(values, -DRIFT), values)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score), in one pass over the positive runs.

    A stack holds candidates with the running sums before and after them. A new run absorbs
    those that it can extend to a larger total; each run enters and leaves the stack once.
    """
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, up, False].astype(np.int8)))
    total = np.r_[0.0, np.cumsum(scores, dtype=np.float64)]
    stack: list[tuple[int, int, float, float]] = []
    for first, last in edge.reshape(-1, 2).tolist():
        left, right = total[first], total[last]
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, last, left, right))
    return [(a, z - 1, r - q) for a, z, q, r in stack]


def evidence(marks: np.ndarray, scores: np.ndarray, rate: float, factor: float):
    """Significant segments with E-values, and the evidence of best and of all in nats.

    A passage that comes again, by the ``marks`` of its words, is found again but told once.
    """
    n = max(len(scores), 1)
    found = []
    best = 0.0
    told: dict[bytes, float] = {}
    for first, last, s in segments(scores):
        e = factor * n * np.exp(-rate * s)
        nats = -np.log(max(e, 1e-300))
        best = max(best, nats)
        if e <= E_VALUE:
            told[marks[first : last + 1].tobytes()] = nats
            found.append((first, last, s, float(e)))
    return found, np.array([1.0, min(best, 40.0), np.log1p(sum(told.values()))])


def _rate(values: np.ndarray) -> float:
    """The positive root of mean(exp(rate * score)) = 1 over background scores."""
    if not len(values) or values.max() <= 0 or values.mean() >= 0:
        return 1.0
    low, high = 1e-6, 50.0 / values.max()
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if np.exp(np.minimum(mid * values, 700)).mean() > 1 else (mid, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic fit; Newton steps, halved until the loss falls."""

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + ridge * w[1:] @ w[1:] / 2

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * np.r_[0, w[1:]]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if size <= 1e-6 or np.abs(step).max() < 1e-9:
            break
    return w


def fit_model(texts: list[bytes], labels: list[int]) -> bytes:
    y = np.array(labels, np.int64)
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in split_words(t)], np.int64) for t in texts]
    buckets = np.array([features(w) for w in number], np.int64).reshape(-1, len(PREFIXES) + 1)
    toxic, clean = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for some, label in zip(docs, labels):
        (toxic if label else clean)[np.unique(buckets[np.unique(some)])] += 1
    share = float((y.sum() + 1) / (len(y) + 2))
    m = {"toxic": toxic, "clean": clean, "share": share, "rate": 1.0, "factor": 1.0}
    m["weights"] = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    if len(set(labels)) < 2:
        return pickle.dumps(m)
    # each document as if it had not been counted
    scored = [
        token_scores(some, log_odds(buckets[some], m, (label, 1 - label))) for some, label in zip(docs, labels)
    ]
    background = [s for s, label in zip(scored, labels) if not label and len(s)]
    if background:
        m["rate"] = _rate(np.concatenate(background))
        tops = np.array([max([s for *_, s in segments(x)], default=0.0) for x in background])
        sizes = np.array([len(x) for x in background], float)
        m["factor"] = float(len(tops) / (sizes * np.exp(-m["rate"] * tops)).sum())
    x = np.array([evidence(some, s, m["rate"], m["factor"])[1] for some, s in zip(docs, scored)])
    m["weights"] = _logistic(x, y)
    return pickle.dumps(m)


class WordScores(dict):
    """Scores of the words met so far; those of new words are computed together."""

    def __init__(self, m: dict):
        self.m = m

    def meet(self, words: list[bytes]) -> None:
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > CACHE_SIZE:
            self.clear()
            new = list(set(words))
        if new:
            buckets = np.array([features(w) for w in new], np.int64)
            self.update(zip(new, log_odds(buckets, self.m).tolist()))


_WORKER: dict = {}


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    out: str = "toxicity",
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``docs`` with a struct ``out``: score (0 to 1, label 1 likelier when higher) and segments.

    ``labels`` holds doc_id and label; at most ``max_labelled`` of them are learned from, and
    nothing but texts is read. ``segments`` are the significant toxic passages of the whole
    text in word positions. Null and empty texts have no segments and the score of a
    text without evidence; without labels of both classes every score is the smoothed
    share of label 1. Equal texts score equally; rows keep their columns (``out`` is replaced).
    """
    model = fit_on_sample(docs, labels, fit_model, max_labelled, text, doc_id)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    segment = pa.struct(
        [("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]
    )
    names = [f.name for f in segment]

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = WordScores(pickle.loads(shared.value))
        table = _WORKER[key]
        m = table.m
        for batch in batches:
            scores, found = [], []
            for t in batch_texts(batch):
                words = split_words(t)
                table.meet(words)
                values = np.fromiter(map(table.__getitem__, words), np.float64, len(words))
                marks = np.fromiter(map(hash, words), np.int64, len(words))
                some, x = evidence(marks, token_scores(marks, values), m["rate"], m["factor"])
                scores.append(float(1 / (1 + np.exp(-np.clip(x @ m["weights"], -30, 30)))))
                found.append([dict(zip(names, s)) for s in some])
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array(found, pa.list_(segment))], names=["score", "segments"]
            )

    return docs.withColumn(out, F.arrow_udf(score, f"struct<score:double,segments:{SEGMENTS}>")(F.col(text)))
