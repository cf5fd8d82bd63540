"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text (letters and bytes of 0x80 and more, A-Z lower-cased), hashed into `SLOTS`.
One weight vector w serves all thresholds t1 <= t2 <= ...: P(grade <= k) = sigmoid(t_k - w.x). Only words whose documents'
grades stand out are weighed, under an L1 penalty, so nearly all words weigh nothing and the length of a text hardly
matters. The result is the expected grade.

Grades are those of the label column if it has more than two values. With two, the marked documents are graded 1 to 3 by
terciles of how many words they hold that are much likelier in marked documents of the training sample. Training takes at most
`PER_CLASS` documents of each label value (the first in the order of a hash of the id); scoring reads every whole text once,
without a shuffle.

Defined cases: null or empty text has no features and gets the score of the thresholds alone. Labels that are null or of a
null id are not learned from; of several labels of one document the largest counts. With fewer than two grades every
severity is the only grade, or 0. Rows are independent; a null doc_id is not held out. Empty table: empty result.
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

SLOTS, PER_CLASS, MOST_VALUES = 1 << 18, 2000, 20
#: Training: a word must be in this many sample documents, and its share of them marked must differ from that of all by so
#: many standard deviations; passes, step, L1 penalty a document.
LEAST_DOCS, APART, PASSES, RATE, L1 = 5, 4.0, 1500, 1.0, 2e-5
#: Words of a log odds over ODDS and in LEAST_MARKED marked documents grade them.
ODDS, LEAST_MARKED = 3.0, 5
_KEYS = np.random.default_rng(9).integers(0, 2**63, 12).astype(np.uint64)
_GAP = np.ones(256, bool)
_GAP[0x41:0x5B] = _GAP[0x61:0x7B] = _GAP[0x80:] = False


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the n+1 bounds of the texts' words."""
    data, offsets = core.bytes_of(texts)
    starts, ends, bounds = words.spans(data, offsets, _GAP)
    return words.hashes(data, starts, ends, fold=True), bounds


def slots(word: np.ndarray) -> np.ndarray:
    return (word & np.uint64(SLOTS - 1)).astype(np.int64)


def minima(word: np.ndarray) -> np.ndarray:
    """Twelve minima over a text's 5-word runs, to tell near copies in the sample."""
    run = words.windows(word, min(5, len(word))) if len(word) else np.zeros(1, np.uint64)
    return np.array([(words.mix(run ^ k)).min() for k in _KEYS], np.uint64).view(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """grades ascending, thresholds between them, and the slots with a weight."""

    grades: np.ndarray
    thresholds: np.ndarray
    slot: np.ndarray
    weight: np.ndarray

    def at_least(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        table = np.zeros(SLOTS)
        table[self.slot] = self.weight
        word, bounds = hashed(texts)
        word, n = slots(word), len(bounds) - 1
        on = np.flatnonzero(table[word])
        key = np.unique((np.searchsorted(bounds, on, "right") - 1) * SLOTS + word[on])  # a word of a text counts once
        x = np.bincount(key // SLOTS, table[key % SLOTS], n)
        return _sigmoid(x[:, None] - self.thresholds)

    def severity(self, p: np.ndarray) -> np.ndarray:
        base = self.grades[0] if len(self.grades) else 0.0
        return base + p @ np.diff(self.grades) if len(self.grades) > 1 else np.full(len(p), float(base))


def unlike(each: np.ndarray) -> list[int]:
    """The sample's documents, by their minima, without later near copies of earlier ones, whose shared words would all seem telling."""
    seen, out = set(), []
    for k, least in enumerate(each):
        bands = {(b, *least[3 * b : 3 * b + 3].tolist()) for b in range(4)}
        if seen.isdisjoint(bands):
            out.append(k)
        seen |= bands
    return out


def train(row: np.ndarray, col: np.ndarray, grade: np.ndarray, features: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and weights by proximal gradient steps with a diagonal scale; (row, col) are the entries of x."""
    top = int(grade.max())
    share = np.array([weight[grade > k].sum() for k in range(top)]) / weight.sum()
    w, t = np.zeros(features), -np.log(share / (1 - share))
    gw, gt = np.full(features, 1e-6), np.full(top, 1e-6)
    weight = weight / weight.sum()
    for _ in range(PASSES):
        x = np.bincount(row, w[col], len(grade))
        edge = np.concatenate([[-40.0], t, [40.0]])
        a, b = _sigmoid(edge[grade] - x), _sigmoid(edge[grade + 1] - x)
        p = np.maximum(b - a, 1e-9)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        dx = weight * (db - da)  # of the loss -log p
        step = np.bincount(col, dx[row], features)
        gw += step**2
        rate = RATE / np.sqrt(gw)
        w -= rate * step
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        dt = np.array([(weight * da)[grade == k + 1].sum() - (weight * db)[grade == k].sum() for k in range(top)])
        gt += dt**2
        t = np.maximum.accumulate(t - RATE / np.sqrt(gt) * dt + np.arange(top) * 1e-9)
    return t, w


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", learn: Column | None = None, per_class: int = PER_CLASS) -> Model:
    core.ship(documents.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    if learn is not None:
        known = known.filter(learn)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    # with more grades the most frequent are learned, the lower on ties; every document is scored all the same
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().orderBy(F.desc("count"), "y").limit(MOST_VALUES).collect()}
    empty = np.zeros(0)
    none = Model(np.array(sorted(total)[:1], float), empty, empty.astype(np.int64), empty)
    if len(total) < 2:
        return none
    picked = [known.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in sorted(total)]
    chosen = picked[0]
    for p in picked[1:]:
        chosen = chosen.unionByName(p)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in core.steps(batches):
            word, bounds = hashed(core.text_of(piece.column("text")))
            each = [word[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
            at, least = [np.unique(slots(w)) for w in each], [minima(w) for w in each]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array(at, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "y", "at", "least"])

    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most MOST_VALUES * per_class rows
    rows = base.mapInArrow(encode, "doc_id long, y int, at array<long>, least array<long>").toArrow().sort_by("doc_id")
    rows = rows.take(pa.array(unlike(rows.column("least").to_numpy()), pa.int64()))
    y = np.asarray(rows.column("y")).astype(int)
    if len(np.unique(y)) < 2:
        return none
    each = rows.column("at").to_numpy()
    row, slot = np.repeat(np.arange(len(y)), [len(x) for x in each]), np.concatenate(list(each)).astype(np.int64)
    weight = np.array([total[v] / (y == v).sum() for v in y])
    values = np.unique(y)
    if len(values) == 2:
        marked = y == values[1]
        with_, without = np.bincount(slot[marked[row]], minlength=SLOTS), np.bincount(slot[~marked[row]], minlength=SLOTS)
        odds = np.log((with_ + 0.5) / (marked.sum() + 1)) - np.log((without + 0.5) / ((~marked).sum() + 1))
        telling = (odds > ODDS) & (with_ >= LEAST_MARKED)
        found = np.bincount(row, telling[slot], len(y))
        cuts = np.unique(np.quantile(found[marked], [1 / 3, 2 / 3]))
        grade = np.where(marked, 1 + np.searchsorted(cuts, found, "left"), 0)
        values, grade = np.unique(grade, return_inverse=True)
    else:
        grade = np.searchsorted(values, y)
    docs, share = np.bincount(slot, minlength=SLOTS), (grade > 0).mean()
    apart = np.bincount(slot[grade[row] > 0], minlength=SLOTS) - docs * share
    used = np.flatnonzero((docs >= LEAST_DOCS) & (np.abs(apart) >= APART * np.sqrt(docs * share * (1 - share))))
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    on = place[slot] >= 0
    t, w = train(row[on], place[slot[on]], grade, len(used), weight)
    keep = np.abs(w) > 1e-6
    return Model(values.astype(float), t, used[keep], w[keep])


def score(df: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """`df` with severity (the expected grade), p_toxic (over the lowest grade) and toxic (p_toxic of a half or more)."""
    fields = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())]

    def run(piece: pa.RecordBatch) -> list:
        p = model.at_least(core.text_of(piece.column(text)))
        some = p[:, 0] if p.shape[1] else np.zeros(len(p))
        return [pa.array(model.severity(p)), pa.array(some), pa.array(some >= 0.5)]

    return core.append(df, fields, run, text)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, severity, p_toxic, toxic of every document, learned from those that are not held out."""
    model = fit(documents, labels, learn=core.remainder("doc_id", 3) != 1)
    out = score(documents.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(core.remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "severity", "p_toxic", "toxic")
