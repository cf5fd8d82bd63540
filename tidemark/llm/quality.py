"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words, the last one shorter; only whole documents carry labels. Each passage is
encoded from rates of byte classes and word statistics, gated attention weights the encodings, and the weighted sum is
scored. Encoder, attention and scorer are trained together by gradient descent on at most `PER_CLASS` labelled documents of
each class (the first in the order of a hash of the id); scoring reads every whole text once, without a shuffle.

Defined cases: null or empty text, or one without words, is a bag of one passage with all features zero and gets that
bag's score. Labels that are null, or of a null id, are not learned from; several labels of one document count as their
mean. Labels without documents are ignored. With no usable label of one of the classes, or none at all, every score is
the smoothed share of good labels. Rows are independent, so repeated rows give repeated results; a null doc_id is not
held out. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, words

PASSAGE, PER_CLASS = 128, 1500
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 16, 8, 250, 0.02, 1e-3
#: A class for each of these bytes; then upper case, lower case, digits, bytes of 0x80 and more, and the rest.
_SINGLE = b" \n.,!?'\"-:;$%&*#@/()<>=_|+~^"
_CLASS = np.full(256, len(_SINGLE) + 4, np.uint8)
for _k, _b in enumerate(_SINGLE):
    _CLASS[_b] = _k
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = (len(_SINGLE) + k for k in range(4))
_CLASSES = len(_SINGLE) + 5
FEATURES = _CLASSES + 6


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the n+1 bounds of the texts' passages."""
    data, offsets = core.bytes_of(texts)
    starts, ends, bounds = words.spans(data, offsets)
    n = np.diff(bounds)
    bags = np.maximum(1, -(-n // PASSAGE))
    first = np.append(0, np.cumsum(bags))
    total = int(first[-1])
    out = np.zeros((total, FEATURES))
    if not len(starts):
        return out, first
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(starts)) - bounds[:-1][doc]
    bag = first[:-1][doc] + place // PASSAGE
    # bytes: a passage runs from its first word to the next passage's first word
    head = np.flatnonzero(place % PASSAGE == 0)
    cut = np.append(starts[head], len(data))
    owner = np.repeat(bag[head], np.diff(cut))
    counts = np.bincount(owner * _CLASSES + _CLASS[data[cut[0] :]], minlength=total * _CLASSES).reshape(total, _CLASSES)
    size = np.maximum(counts.sum(1, keepdims=True), 1)
    out[:, :_CLASSES] = np.sqrt(counts / size)
    # words
    per = np.maximum(np.bincount(bag, minlength=total), 1)
    lens = (ends - starts).astype(float)
    mean = np.bincount(bag, lens, total) / per
    spread = np.sqrt(np.maximum(np.bincount(bag, lens**2, total) / per - mean**2, 0))
    capital = np.bincount(bag, _CLASS[data[starts]] == len(_SINGLE), total) / per
    last = _CLASS[data[ends - 1]]
    odd = np.bincount(bag, (last < len(_SINGLE)) | (last == _CLASSES - 1), total) / per
    key = np.sort((bag.astype(np.uint64) << np.uint64(40)) | (words.hashes(data, starts, ends, fold=True) >> np.uint64(24)))
    new = np.append(True, key[1:] != key[:-1])
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=total) / per
    out[:, _CLASSES:] = np.stack([mean / 10, spread / 10, capital, odd, distinct, np.log1p(np.bincount(bag, minlength=total)) / 5], 1)
    return out, first


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first[:-1], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Parameters by name; `mean` and `scale` standardise the features. Without parameters, `prior` is every score."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        lens = np.diff(first)
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), lens))
        a /= np.repeat(_sum(a, first), lens)
        z = _sum(a[:, None] * h, first)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, first)["score"] if self.p else np.full(len(first) - 1, self.prior)


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> Model:
    """Adam on the weighted log loss of the bags, all at once."""
    mean = x.mean(0)
    scale = np.maximum(x.std(0), 1e-3)
    rng = np.random.default_rng(1)
    p = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
    model = Model(p, mean, scale, prior)
    x = (x - mean) / scale
    weight = weight / weight.sum()
    lens = np.diff(first)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for turn in range(1, EPOCHS + 1):
        f = model.forward(x, first)
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        ds = weight * (f["score"] - y)
        dz = np.repeat(ds, lens)[:, None] * p["c"]
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(_sum(a * da, first), lens))
        dt, dg = de[:, None] * p["w"] * g * (1 - t**2), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ ds, "d": ds.sum()}
        for k in p:
            step = grad[k] + DECAY * p[k] * (k not in "bd")
            m[k] = 0.9 * m[k] + 0.1 * step
            v[k] = 0.99 * v[k] + 0.01 * step**2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.99**turn)) + 1e-8)
    model.p = p
    return model


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "quality", learn: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """A model from the labelled documents that `learn` (on doc_id) allows."""
    core.ship(documents.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    if learn is not None:
        known = known.filter(learn)
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    if len(total) < 2:
        return Model({}, np.zeros(0), np.zeros(0), prior)
    picked = [known.filter(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * per_class rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in core.steps(batches):
            x, first = passages(core.text_of(piece.column("text")))
            flat = [x[i:j].ravel() for i, j in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array(flat, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    rows = base.mapInArrow(encode, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    y = np.asarray(rows.column("y")).astype(float)
    if not 0 < y.sum() < len(y):
        return Model({}, np.zeros(0), np.zeros(0), prior)
    bags = [np.asarray(x).reshape(-1, FEATURES) for x in rows.column("x").to_numpy()]
    first = np.append(0, np.cumsum([len(b) for b in bags]))
    weight = np.where(y == 1, total[1] / y.sum(), total[0] / (len(y) - y.sum()))
    return train(np.concatenate(bags), first, y, weight, prior)


def score(df: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """`df` with the model's score of each text."""

    def run(piece: pa.RecordBatch) -> list:
        return [pa.array(model.scores(*passages(core.text_of(piece.column(text)))))]

    return core.append(df, [T.StructField(name, T.DoubleType())], run, text)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from those that are not held out."""
    model = fit(documents, labels, learn=core.remainder("doc_id", 3) != 1)
    scored = score(documents.select("doc_id", "text"), model)
    held_out = F.coalesce(core.remainder("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
