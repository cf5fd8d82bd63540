"""Near-duplicate documents by b-bit MinHash, confirmed on the full shingle sets.

A document's set is its distinct 5-word shingles (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+; a shorter text is one
shingle). Two documents are linked where 100 * intersection >= 75 * union; a group is a connected component.

1. Sketch: 128 minima; every 4 of them make a band key (32 bands miss a pair at exactly 0.75 once in 200,000), and the low
   2 bits of each are kept, packed into 32 bytes.
2. Documents of equal sets (128 bits from two independent streams of shingle hashes) are one class from here on, one row a
   class, whatever its size.
3. Candidates: classes that share a band key. In a bucket of up to `BUCKET` classes the packed signatures are compared by
   bit counts, corrected for chance collisions (a quarter of the unequal minima agree in 2 bits), and a spanning forest of
   the pairs at `FLOOR` or more goes on. A larger bucket would cost the square of its members, and split into chunks its
   trees would have to be joined again, so it goes on whole, as a star; `links.across` is made for those. Candidates grow with
   members, not with pairs.
4. The components of those candidates hold every link inside; `links.resolve` finds them, on the full sets.

Rows shuffled are a document's own shingles and band keys; texts travel once, to become sets. Nothing is capped or sampled.

Defined cases: null or empty text, or one without words, has an empty set, `n_shingles` 0, and is linked with nothing. A
null doc_id takes no part: component_id is null and kept true. Rows that share a doc_id are one node with the sets of all
of them and each gives a row. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, links, words

#: 5-word shingles, linked at a similarity of 0.75.
RULE = links.Rule(shingle=5, percent=75)
BANDS, ROWS, BITS = 32, 4, 2
#: Least estimate that is worth an exact look: 5 standard deviations under the rule's.
FLOOR = 0.5
#: Classes of a bucket whose signatures are compared.
BUCKET = 512
_N = BANDS * ROWS
_RNG = np.random.default_rng(4_000_037)
_XOR = _RNG.integers(0, 2**64 - 1, _N, np.uint64, endpoint=True)
_MUL = _RNG.integers(0, 2**64 - 1, _N, np.uint64, endpoint=True) | np.uint64(1)
_BAND = _RNG.integers(0, 2**64 - 1, (BANDS, ROWS), np.uint64, endpoint=True) | np.uint64(1)


def sketch(values: np.ndarray, more: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-empty sets: 128-bit fingerprints (64 of each stream), band keys, and packed low bits."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    if not len(starts):
        return np.zeros((0, 2), np.uint64), np.zeros((0, BANDS), np.uint64), np.zeros((0, _N * BITS // 64), np.uint64)
    prints = links.prints(values, more, starts)
    minima = np.empty((len(starts), _N), np.uint64)
    for k in range(_N):
        v = values ^ _XOR[k]
        v *= _MUL[k]
        v >>= np.uint64(32)
        minima[:, k] = np.minimum.reduceat(v, starts)
    keys = words.mix((words.mix(minima.reshape(-1, BANDS, ROWS) + _BAND) * _BAND).sum(2, dtype=np.uint64))
    low = minima & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    packed = np.bitwise_or.reduce(low.reshape(len(starts), -1, per) << shifts, axis=2)
    return prints, keys, packed


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis: their words), corrected for chance collisions."""
    x = a ^ b
    unequal = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    agree = 1 - np.bitwise_count(unequal).sum(-1, dtype=np.int64) / _N
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


_SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType(), False)), T.StructField("sig", T.BinaryType())])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in core.steps(batches):
        values, more, bounds = links.sets(core.text_of(piece.column("text")), RULE.shingle, both=True)
        n = np.diff(bounds)
        prints, keys, packed = sketch(values, more, bounds)
        some = n > 0
        row = np.cumsum(some) - 1
        take = [int(r) if s else None for r, s in zip(row, some)]
        index = pa.array(take, pa.int64())
        width = packed.shape[1] * 8

        def fixed(m: np.ndarray, size: int) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(size), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary()).take(index)

        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), fixed(prints, 16), lists.take(index), fixed(packed, width)], names=_SKETCH.names)


def _forest(ids: np.ndarray, size: np.ndarray, sig: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of a bucket's pairs whose sizes allow a link and whose estimate is at FLOOR or more."""
    n, out = len(ids), []
    left = np.ones(n, bool)
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        queue = [root]
        while queue and left.any():
            i = queue.pop()
            rest = np.flatnonzero(left)
            ok = RULE.fits(size[rest], size[i]) & (estimate(sig[rest], sig[i]) >= FLOOR)
            new = rest[ok]
            left[new] = False
            out += [(int(ids[i]), int(ids[j])) for j in new]
            queue += new.tolist()
    return out


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in links.runs(batches, ["key"]):
        ids, size = np.asarray(table.column("doc_id")), np.asarray(table.column("n_shingles"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(ids), -1)
        cuts = np.array(links.cuts_of(table, ["key"]))
        n = np.diff(cuts)
        at = cuts[:-1][n == 2]  # pairs all at once
        ok = RULE.fits(size[at], size[at + 1]) & (estimate(sig[at], sig[at + 1]) >= FLOOR)
        edges = list(zip(ids[at[ok]].tolist(), ids[at[ok] + 1].tolist()))
        for i, j in zip(cuts[:-1][n > 2].tolist(), cuts[1:][n > 2].tolist()):
            edges += _forest(ids[i:j], size[i:j], sig[i:j])
        if edges:
            yield links.edge_batch([e[0] for e in edges], [e[1] for e in edges])


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `documents` (doc_id, text)."""
    rows = components(documents.select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and print (the fingerprint of the set, null if empty) of every row."""
    spark = documents.sparkSession
    scratch = core.Scratch(spark, "minhash")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sketches = scratch.write(docs.mapInArrow(_sketches, _SKETCH), "sketches")
    some = sketches.filter("doc_id is not null and n_shingles > 0")
    classes = some.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), *[F.min_by(c, "doc_id").alias(c) for c in ("n_shingles", "keys", "sig")])
    classes = scratch.write(classes, "classes")

    # candidates
    rows = classes.select(F.explode("keys").alias("key"), "doc_id", "n_shingles", "sig")
    buckets = scratch.write(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("head")).filter("n > 1").withColumn("whole", F.col("n") > BUCKET), "buckets")
    shared = scratch.write(core.attach(rows, buckets, "key"), "shared")
    small = shared.filter("NOT whole").select("key", "doc_id", "n_shingles", "sig")
    tree = small.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_bucket_edges, links.EDGES)
    star = shared.filter("whole AND doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    edges = scratch.write(tree.unionByName(star), "candidate-edges")
    scratch.drop("shared", "buckets")
    return links.resolve(docs, sketches.select("doc_id", "n_shingles", "print"), classes.select("print", "doc_id", "n", "n_shingles"), edges, classes.select("doc_id", "keys"), RULE, scratch)
