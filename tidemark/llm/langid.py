"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything that is no letter is one kind of gap, and n-grams of 1 to 3 characters are hashed into
`BUCKETS`. Document frequencies are counted over every document that may be learned from. The weights are trained by
follow-the-regularised-leader with elastic-net penalties on about `PER_LANGUAGE` documents of each language, at most
`MOST_DOCUMENTS` (those of the smallest hashes of the id, by a threshold, so no sort of the corpus), and a temperature is then fitted on a fifth of these
that training leaves aside. Prediction reads each whole text once, without a shuffle.

Defined cases: null text or text without a letter is `und` with score 0. Documents with a null language or id are not
learned from; without any learned language everything is `und` with score 0, with only one it is that one with score 1.
Ties go to the language first in order. Rows are independent; a null doc_id is not held out. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

BUCKETS, ORDERS, PER_LANGUAGE = 4096, 3, 600
#: Training documents in all, about; with more than ten languages each gets an equal share of them.
MOST_DOCUMENTS = 6000
#: Languages at most that a model learns: the most frequent ones, the smaller name on ties. Every document gets a prediction all the same.
MOST_LANGUAGES = 1000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.002, 3
_ROWS = 128
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B)]
_SALT = np.array([0x27D4EB2F, 0x165667B1, 0xC2B2AE35], np.uint32)


def _letters(low: int = 0x32000) -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(low)])


_LETTER = _letters()


def counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the hashed n-grams of each text: a row of BUCKETS each."""
    low = [f" {(t or '').lower()} " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.array([len(t) for t in low])
    row = np.repeat(np.arange(len(low), dtype=np.int64) * BUCKETS, lens)
    gap = np.where(code < len(_LETTER), ~_LETTER[np.minimum(code, len(_LETTER) - 1)], True)  # letters end below
    code = np.where(gap, np.uint32(32), code)
    keep = ~gap | np.append(True, ~gap[:-1])  # a run of gaps is one
    code, row = code[keep], row[keep]
    total = np.zeros(len(low) * BUCKETS, np.int64)
    h = np.zeros(len(code), np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n in range(ORDERS):
        if len(code) <= n:
            break
        h = (h[: len(code) - n] ^ code[n:]) * _MUL[0]
        h ^= h >> np.uint32(15)
        same = row[: len(code) - n] == row[n:]
        slot = ((h * _MUL[1] + _SALT[n]) >> shift).astype(np.int64) + row[: len(code) - n]
        total += np.bincount(slot[same], minlength=len(total))
    return total.reshape(len(low), BUCKETS)


def weigh(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, score = [], np.zeros(len(texts))
        known = [bool(self.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
        best = np.zeros(len(texts), np.int64)
        if len(self.languages) > 1:
            p = _softmax(weigh(counts(texts), self.idf) @ self.weights / self.temperature)
            best, score = p.argmax(1), p.max(1)
        elif self.languages:
            score += 1
        for k, ok in enumerate(known):
            names.append(self.languages[best[k]] if ok else "und")
        return names, np.where(known, score, 0.0)


def train(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """FTRL-proximal, one row at a time in the given order."""
    z, n = np.zeros((2, x.shape[1], classes))
    for _ in range(EPOCHS):
        for row, label in zip(x, y):
            on = np.flatnonzero(row)
            zi, ni, v = z[on], n[on], row[on, None]
            w = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0)
            g = _softmax((v * w).sum(0))
            g[label] -= 1
            g = v * g
            new = ni + g**2
            z[on] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / ALPHA * w
            n[on] = new
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, on a grid."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(documents: DataFrame, *, learn: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """A model from `documents` (doc_id, text, lang) where `learn` allows."""
    core.ship(documents.sparkSession)
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null and doc_id is not null")
    if learn is not None:
        base = base.filter(learn)
    found = {r["lang"]: r["count"] for r in base.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    if len(found) == MOST_LANGUAGES:
        base = base.filter(F.col("lang").isin(list(found)))
    languages = sorted(found)
    none = Model(languages, np.zeros(BUCKETS), np.zeros((BUCKETS, len(languages))), 1.0)
    if len(languages) < 2:
        return none

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for piece in core.steps(batches):
            for at in range(0, piece.num_rows, _ROWS):
                part = piece.slice(at, _ROWS)
                total += (counts(part.column("text").to_pylist()) > 0).sum(0)
                n += part.num_rows
        yield pa.RecordBatch.from_pydict({"bucket": np.arange(-1, BUCKETS), "n": np.append(n, total)})

    rows = base.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(BUCKETS + 1)
    seen[np.asarray(rows.column("bucket")) + 1] = np.asarray(rows.column("n"))
    idf = np.log((1 + seen[0]) / (1 + seen[1:])) + 1
    per_language = min(per_language, max(5, MOST_DOCUMENTS // len(languages)))
    # about per_language rows of each language: those whose hash is under a share of the range
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(v) for k, n in found.items() for v in (k, int(min(1.0, per_language / n) * (1 << 30)))])
    sample = base.filter(draw < share[F.col("lang")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in core.steps(batches):
            for at in range(0, piece.num_rows, _ROWS):
                part = piece.slice(at, _ROWS)
                c = counts(part.column("text").to_pylist())
                on = [np.flatnonzero(r) for r in c]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(on, pa.list_(pa.int64())), pa.array([r[i] for r, i in zip(c, on)], pa.list_(pa.int64()))], names=["doc_id", "lang", "at", "n"])

    rows = sample.mapInArrow(encode, "doc_id long, lang string, at array<long>, n array<long>").toArrow().sort_by("doc_id")
    count = np.zeros((rows.num_rows, BUCKETS), np.float32)
    for k, (at, n) in enumerate(zip(rows.column("at").to_numpy(), rows.column("n").to_numpy())):
        count[k, at] = n
    x, y = weigh(count, idf), np.array([languages.index(v) for v in rows.column("lang").to_pylist()], np.int64)
    order = np.random.default_rng(7).permutation(len(y))
    aside, kept = order[::5], np.setdiff1d(order, order[::5], assume_unique=True)
    kept = np.random.default_rng(8).permutation(kept)
    weights = train(x[kept], y[kept], len(languages))
    return Model(languages, idf, weights, calibrate(x[aside] @ weights, y[aside]))


def identify(df: DataFrame, model: Model, *, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`df` with the predicted language of each text and its calibrated probability."""

    def run(piece: pa.RecordBatch) -> list:
        out, scores = [], []
        for at in range(0, piece.num_rows, _ROWS):
            name, score = model.predict(piece.slice(at, _ROWS).column(text).to_pylist())
            out += name
            scores.append(score)
        return [pa.array(out, pa.string()), pa.array(np.concatenate(scores))]

    return core.append(df, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], run, text)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that are not held out."""
    model = fit(documents, learn=core.remainder("doc_id", 4) != 2)
    out = identify(documents.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(core.remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
