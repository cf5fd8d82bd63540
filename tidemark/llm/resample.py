"""Importance resampling towards a target distribution, over hashed runs of words.

Features of a text are all runs of 1 to `GRAMS` consecutive words, joined by one space, repeats counted (A-Z lower-cased,
words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+). A feature's bucket is the crc32 of its bytes modulo the number of buckets.

The crc of all features of a piece of text is taken at once. A crc is an exclusive or: each byte adds a value that depends
on the byte and on its distance from the feature's end alone, and the length adds a constant. So the values come out of one
table by (distance, byte), and `bitwise_xor.reduceat` folds them over the features' spans: all runs of k words that do not
overlap at once, k times. Spans of over `REACH` bytes are folded by blocks of that size: what is left of the blocks before
goes into the first four bytes of the next.

1. Both tables are counted by bucket; a task sends one row a bucket, whatever it has read.
2. The gains are as many numbers as there are buckets (a parameter), and go to the second pass, which sums them over each
   document's features. Texts never travel.
3. Scores (a long and an id each) are sorted by range; a row's rank is its place in its range after the ranges before it.

Defined cases: null or empty text, or one without words, has no features, weight 0 and a score of its own noise; it counts
as short. A null doc_id has a weight, but no score and no rank, and is not among the documents drawn from. Rows that share
a doc_id are rows of their own with the same noise; of equal scores and ids the one of the larger weight, then of more
features comes first. An empty target: all t are 0. Empty table: empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, words

GRAMS, BUCKETS, SEED = 3, 10_000, 42
#: Documents of fewer words are not drawn; of the others so many percent are.
LEAST_WORDS, PERCENT = 20, 5
#: All but 0-9, A-Z, a-z and bytes of 0x80 and more.
APART = np.array([not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])
#: Distances from a span's end that the table holds (with 256 entries of four bytes each, it stays in a core's cache).
REACH = 64
#: Text bytes a numpy step works on: its features are about six times as many.
STEP = 1 << 15
_POLY = 0xEDB88320


def _tables(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """What a byte at each distance from the end adds, at distance * 256 + byte; and the crc of so many zero bytes, which is all that a length adds."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(_POLY), value >> 1)
    out = [value]
    for _ in range(reach - 1):
        out.append((out[-1] >> 8) ^ value[out[-1] & 0xFF])
    return np.concatenate(out), np.array([zlib.crc32(bytes(n)) for n in range(reach + 1)], np.uint32)


ADDS, LENGTH = _tables(REACH)
_ALL = np.uint32(0xFFFFFFFF)


def _short(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of spans that come one after the other, each of at least a byte and at least a byte apart; right for those of up to REACH bytes."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    cuts = np.stack([starts, ends], 1).ravel()
    at = np.repeat((cuts[1:] - 1) << 8, np.diff(cuts))  # spans and what lies between them
    at -= np.arange(cuts[0] << 8, cuts[-1] << 8, 256)
    at |= data[cuts[0] : cuts[-1]]
    return np.bitwise_xor.reduceat(np.take(ADDS, at, mode="clip"), cuts[:-1] - cuts[0])[::2] ^ LENGTH[np.minimum(ends - starts, REACH)]


def _long(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of any spans, block by block from their starts: the odd part first, then whole blocks, each with the register before it in its first bytes."""
    head, left = (ends - starts) % REACH, (ends - starts) // REACH
    state = np.full(len(starts), _ALL)
    for k in np.flatnonzero(head).tolist():
        state[k] = np.bitwise_xor.reduce(ADDS[(np.arange(head[k])[::-1] << 8) | data[starts[k] : starts[k] + head[k]]]) ^ LENGTH[head[k]] ^ _ALL
    at, steps = starts + head, np.arange(REACH)
    far = (REACH - 1 - steps) << 8
    open_ = np.flatnonzero(left)
    while len(open_):
        block = data[at[open_][:, None] + steps]
        block[:, :4] ^= state[open_].astype("<u4").view(np.uint8).reshape(-1, 4)
        state[open_] = np.bitwise_xor.reduce(ADDS[far | block], axis=1)
        at[open_] += REACH
        left[open_] -= 1
        open_ = open_[left[open_] > 0]
    return state ^ _ALL


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of spans that come one after the other."""
    out = _short(data, starts, ends)
    long = np.flatnonzero(ends - starts > REACH)
    if len(long):
        out[long] = _long(data, starts[long], ends[long])
    return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature of the texts, the text it is of, and the number of words of each text."""
    data, offsets = core.bytes_of(texts)
    starts, ends, bounds = words.spans(data, offsets, APART)
    n = np.diff(bounds)
    size = ends - starts
    # the words one after the other, a space behind each
    first = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    byte = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    joined[byte] = words.FOLD[data[byte - np.repeat(first - starts, size)]]
    last = first + size
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    place = np.arange(len(doc)) - np.repeat(bounds[:-1], n)
    left = np.repeat(n, n) - place
    found, owner = [], []
    for k in range(1, GRAMS + 1):
        for turn in range(k):  # runs of k words that do not overlap
            at = np.flatnonzero((left >= k) & (place % k == turn))
            found.append((crcs(joined, first[at], last[at + k - 1]) % np.uint32(buckets)).astype(np.int32))
            owner.append(doc[at])
    return np.concatenate(found), np.concatenate(owner), n


def counts(texts: DataFrame, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts fall in each bucket (buckets of none are left out)."""
    core.ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for piece in core.steps(batches, text, STEP):
            total += np.bincount(features(core.text_of(piece.column(text)), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    return texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 ln(its smoothed share in the target / its smoothed share in the documents)); `buckets` numbers, whatever the tables hold."""
    told = []
    for df in (target, documents):
        n = np.zeros(buckets, np.int64)
        for r in counts(df, buckets).toLocalIterator():
            n[r.bucket] = r.n
        told.append(n)
    (t, s), (all_t, all_s) = ((n.astype(np.float64) for n in told), (float(n.sum()) for n in told))
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))


def weigh(documents: DataFrame, gain: np.ndarray, name: str = "weight") -> DataFrame:
    """`documents` with n_words, n_features and the sum of gains over their features."""
    buckets = len(gain)

    def run(piece: pa.RecordBatch) -> list:
        bucket, doc, n = features(core.text_of(piece.column("text")), buckets)
        total = np.bincount(doc, weights=gain[bucket], minlength=len(n)).astype(np.int64)
        return [n.astype(np.int64), np.bincount(doc, minlength=len(n)).astype(np.int64), total]

    return core.append(documents, [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", name)], run, limit=STEP)


def noise(doc_id: str, seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths from the digest of seed and id: the same wherever and whenever it is drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def rank(rows: DataFrame, order: list[Column], share: Column, scratch: core.Scratch) -> DataFrame:
    """`rows` with `rank`, their place from 1 in `order`, down to `share`, a number that may use `n`, how many rows there are; null beyond.

    The rows are dealt out by ranges of `order` and written; then a row's place is that in its range, plus the sizes of the
    ranges before, of which there is a row each.
    """
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = scratch.write(rows.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)), "ranges")
    sizes = sorted((r["range"], r["count"]) for r in rows.groupBy("range").count().collect())  # one row a partition
    before = dict(zip((k for k, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist()))
    start = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "range int, before long")
    n = F.lit(sum(k for _, k in sizes))
    at = F.col("before") + F.col("place") + 1
    return rows.withColumn("n", n).join(start, rows["range"].cast("int") == start["range"]).withColumn("rank", F.when(at <= share, at)).drop("range", "place", "before", "n")


def draw(documents: DataFrame, target: DataFrame, *, percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """`documents` (doc_id, any other columns, no texts) with n_words, n_features, weight, score and rank.

    The rank is 1, 2, ... for the `percent` of the documents of `least` words and more that have the highest scores (ties to
    the smaller doc_id), which is a draw without replacement in proportion to exp(weight / 1000), and null for all others.
    """
    scratch = core.Scratch(documents.sparkSession, "resample")
    rows = weigh(documents, gains(documents, target, buckets)).drop("text").withColumn("score", F.col("weight") + noise("doc_id", seed))
    rows = scratch.write(rows, "weights")
    may = F.col("n_words") >= least
    own = rows.select("doc_id", "n_features", "weight", "score", "n_words", *[c for c in rows.columns if c not in ("doc_id", "n_features", "weight", "score", "n_words")])
    some = rank(own.filter(may & F.col("doc_id").isNotNull()), [F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.desc("n_features")], F.floor(F.col("n") * percent / 100), scratch)
    rest = own.filter(~(may & F.col("doc_id").isNotNull())).withColumn("rank", F.lit(None).cast("long"))
    return some.unionByName(rest)


def report(documents: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, all long."""
    out = draw(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), target)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_features", "weight", "score", "rank")])
