"""Quality scores from naive Bayes support vectors.

A text becomes the set of its n-gram indicators: byte trigrams, lower-cased words and
word pairs, runs of three word shapes (letter case, digits, marks, and whether a word
repeats the one before), and the binned share of repeated and of distinct words, each
hashed to a slot. Indicators are scaled by the log ratio of their smoothed class counts
and the vector is brought to length one; a linear hinge-loss model is fitted by dual
coordinate descent, and its margins are turned into probabilities by a logistic curve
fitted on labelled rows that the first fit has not seen.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, the ones of smallest hash of
the id, with at most ``TRAIN_BYTES`` of slots, which are the only bounds; every text is scored whole. Ids, languages and sources
are never read as features. Null text is empty; empty texts get the score of the
intercept; labels other than 0 and 1 and null labels are not learnt from; the least
label of an id counts; without two classes every score is the share of label 1 (at
most 0.999, which it is without any label). Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import cut, drop

TRAIN_ROWS, TRAIN_BYTES = 4_000, 64 << 20
BITS = 18
SLOTS = 3 << BITS
_SHAPES = {"lower": 1, "Title": 2, "UPPER": 3, "digit": 4, "marks": 5, "mixed": 6}
_MARKS = re.compile(rb"[^\w\s.,;:'\"()\x80-\xff-]")


def _shape(word: bytes) -> int:
    bare = word.strip(b".,;:'\"()-")
    if not bare:
        return _SHAPES["marks"]
    if _MARKS.search(bare):
        return _SHAPES["mixed"] if bare[:1].isalnum() else _SHAPES["marks"]
    if bare.isdigit():
        return _SHAPES["digit"]
    if bare.islower() or bare[:1] > b"\x7f" and bare[1:].islower():
        return _SHAPES["lower"]
    if len(bare) > 1 and bare.isupper():
        return _SHAPES["UPPER"]
    return _SHAPES["Title"]


class _Shapes(dict):
    """Shapes of words seen, at most 200,000 of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = _shape(word)
        return out


_shapes = _Shapes()


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct slots of the text's n-grams."""
    data = (text or "").encode()
    out = []
    mask, mix = np.uint32((1 << BITS) - 1), np.uint32(2654435761)
    if len(data) > 2:
        d = np.frombuffer(data, np.uint8).astype(np.uint32)
        out.append(((d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)) * mix) >> np.uint32(32 - BITS))
    raw = data.split()
    n = len(raw)
    if n:
        words = np.fromiter(map(crc32, data.lower().split()), np.uint32, n)
        out.append((words & mask) + np.uint32(1 << BITS))
        pairs = (words[:-1] * np.uint32(31) + words[1:]) * mix >> np.uint32(32 - BITS)
        out.append(pairs + np.uint32(2 << BITS))
        shape = np.fromiter(map(_shapes.__getitem__, raw), np.uint32, n)
        same = np.zeros(n, np.uint32)
        same[1:] = words[1:] == words[:-1]
        shape += same * np.uint32(8)
        runs = shape[:-2] + shape[1:-1] * np.uint32(16) + shape[2:] * np.uint32(256)
        share = [0, *np.searchsorted([0.001, 0.01, 0.03, 0.1, 0.3, 0.6], [same.mean()])]
        distinct = [1, *np.searchsorted([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], [len(np.unique(words)) / n])]
        marked = [2, *np.searchsorted([0.001, 0.01, 0.03, 0.1, 0.3, 0.6], [((shape & np.uint32(7)) >= 5).mean()])]
        upper = [3, *np.searchsorted([0.001, 0.01, 0.03, 0.1, 0.3, 0.6], [((shape & np.uint32(7)) == 3).mean()])]
        size = int(n).bit_length()
        bins = [(a * 16 + b) * 32 + s for a, b in (share, distinct, marked, upper) for s in (0, size)]
        extra = np.concatenate([runs, np.array(bins, np.uint32) + np.uint32(1 << 16)])
        out.append((extra * mix >> np.uint32(32 - BITS)) + np.uint32(2 << BITS))
    return np.unique(np.concatenate(out)).astype(np.int32) if out else np.zeros(0, np.int32)


class Model:
    """Weights by slot; ``score`` gives the probability of label 1."""

    def __init__(self, weights: np.ndarray, ratio: np.ndarray, intercept: float, slope: float, shift: float):
        self.by_slot = (weights * ratio).astype(np.float32)
        self.square = (ratio * ratio).astype(np.float32)
        self.intercept, self.slope, self.shift = intercept, slope, shift

    def margin(self, slots: np.ndarray) -> float:
        norm = float(self.square[slots].sum(dtype=np.float64)) ** 0.5
        return (float(self.by_slot[slots].sum(dtype=np.float64)) / norm if norm else 0.0) + self.intercept

    def score(self, slots: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -40, 40))))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss (bias as one more constant feature)."""
    rng = np.random.default_rng(11)
    w, bias, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(rows))
    x = [ratio[r] for r in rows]
    x = [v / (np.sqrt(v @ v) or 1.0) for v in x]
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - g / (2.0 if len(x[i]) else 1.0), 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                bias += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def _ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(SLOTS, smooth), np.full(SLOTS, smooth)
    for r, label in zip(rows, y):
        (p if label > 0 else q)[r] += 1
    p /= np.count_nonzero(y > 0) + 2 * smooth
    q /= np.count_nonzero(y < 0) + 2 * smooth
    return np.log(p / q)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 12) -> Model:
    """Fit on slots of texts and their labels (0 or 1), in the order given."""
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        share = min(max(float((y > 0).mean()) if len(y) else 1.0, 0.001), 0.999)
        return Model(np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 1.0, float(np.log(share / (1 - share))))
    held = np.arange(len(y)) % 4 == 3
    a, b, ratio, w, bias = 1.0, 0.0, None, None, 0.0
    if len(set(y[held].tolist())) == 2 and len(set(y[~held].tolist())) == 2:
        some = [r for r, h in zip(rows, held) if not h]
        ratio = _ratio(some, y[~held])
        first = Model(*(lambda wb: (wb[0], ratio, wb[1]))(_descend(some, y[~held], ratio, cost, rounds)), 1.0, 0.0)
        m = np.array([first.margin(r) for r, h in zip(rows, held) if h])
        t = (y[held] > 0).astype(float)
        t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        for _ in range(50):  # Newton steps on the logistic loss, slightly ridged
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
            v = p * (1 - p)
            g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
            h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
            d = np.linalg.solve(h, g)
            a, b = a - d[0], b - d[1]
            if np.abs(d).max() < 1e-8:
                break
    ratio = _ratio(rows, y)
    w, bias = _descend(rows, y, ratio, cost, rounds)
    return Model(w, ratio, bias, float(max(a, 1e-3)), float(b))


def _with_slots(df: DataFrame) -> DataFrame:
    """key, label and slots (32-bit integers as bytes) of the rows key, label, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([indicators(x.as_py()).tobytes() for x in b.column(2)], pa.binary())], names=["key", "label", "slots"])

    return df.mapInArrow(run, T.StructType([T.StructField("key", df.schema.fields[0].dataType), T.StructField("label", T.IntegerType()), T.StructField("slots", T.BinaryType())]))


def train(docs: DataFrame, labels: DataFrame, label: str = "label", key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Model:
    """Fit on the ``rows`` labels of smallest id hash and their texts, as many of them in that
    order as have slots of ``most`` bytes together.

    The bounded sample of labels is broadcast to the texts; only slots reach the driver. Of
    several texts of one id the one of smallest hash is learnt from, so fits don't vary."""
    some = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(F.col(label).cast("int")).alias("label"))
    some = some.orderBy(F.xxhash64(key), key).limit(rows)
    texts = docs.select(key, F.col(text).alias("__text")).join(F.broadcast(some), key).select(key, "label", "__text")
    one = _with_slots(texts).groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("slots").alias("h"), "slots")).alias("s"))
    one = cut(one.select("key", "label", "s.slots"), "sample")
    before = F.sum(F.length("slots")).over(Window.orderBy(F.xxhash64("key"), "key"))
    fits = one.select("key", F.length("slots").alias("__n"), before.alias("__upto")).where(F.col("__upto") <= most).select("key")
    got = sorted(one.join(F.broadcast(fits), "key", "left_semi").collect(), key=lambda r: r["key"])
    drop(one)
    return fit([np.frombuffer(r["slots"], np.int32) for r in got], np.array([r["label"] for r in got]))


def score(df: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and score of every row. The model's arrays (a few MB, fixed) are broadcast once."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            scores = [m.score(indicators(x.as_py())) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(scores, pa.float64())], names=[*keys, "score"])

    some = df.select(*keys, F.col(text).alias("__text"))
    return some.mapInArrow(run, T.StructType([*some.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model for the tables documents and labels; held-out rows are never read for it."""
    return train(docs, labels.where(~held_out()), label="quality")


def keep(docs: DataFrame, model: Model, threshold: float = 0.7, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, in one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield b.filter(pa.array([m.score(indicators(x.as_py())) >= threshold for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
