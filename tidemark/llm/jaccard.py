"""Jaccard join of word n-grams by parity sketches.

A document's set: its distinct 3-word shingles (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+; a shorter text is one shingle).
Two are linked where 100 * intersection >= 90 * union; a group is a connected component of links.

A sketch is a row of bits in which each shingle flips the one it is hashed to. Shingles in both sets flip the same bits, so
the Hamming distance of two sketches is at most the size of the symmetric difference, and that is at most
D = (|A| + |B|) * (100 - percent) / (100 + percent) for linked sets. Cut into more than D parts, linked sketches have a part
in common: no link is missed, whatever the hashes do.

1. Size bands (`bands`): all sketches of a band have the same parts, enough for its largest sizes. A document goes to its
   own band and, as a guest, to any further one that holds sizes it can be linked with. Sets too small for a difference at
   all are linked by equality alone and need no sketch.
2. Parts of few set bits are alike by chance. There are `spare` parts more than D + 1, so a linked pair has more than
   `spare` in common; a document with no more weak parts than that leaves them out. What is left holds at least `WEAK` of
   some 500 bits, and a chance match is once in 10^8 to 10^11.
3. Documents of equal sets (128 bits) are one class, one row from here on. A class sends a row of 16 bytes for each part;
   a task first folds the rows it has read by key, so a part that a third of all documents share is a row a task; then the
   rows of a key, sorted, are read as a stream in which each is tied to the first. No pairs within a key are made.
4. What hangs together by those ties holds every link, and `links.resolve` verifies on the full sets.

Rows grow with the words of a text (one for each six or so). Nothing is capped or sampled.

Defined cases: null or empty text, or one without words, has an empty set, `n_shingles` 0, and is linked with nothing. A
null doc_id takes no part: its component_id is null. Rows that share a doc_id are one node with the sets of all of them and
each gives a row. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core, links, words

#: 3-word shingles, linked at a similarity of 0.9.
RULE = links.Rule(shingle=3, percent=90)
#: Largest size of a band by its smallest.
GROWTH = 1.25
#: Bits of a part, and set bits under which a part is weak.
BITS, WEAK = 512, 3
#: Rows that a task folds by key at a time.
FOLD = 1 << 18
_SEED = np.random.default_rng(13_000_027).integers(0, 2**64 - 1, 4, np.uint64, endpoint=True)


def bands(largest: int, rule: links.Rule = RULE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest size of each band up to that of `largest`, its parts, and how many of those are spare."""
    far = lambda total: total * (100 - rule.percent) // (100 + rule.percent)  # noqa: E731  symmetric difference of linked sets
    low = next(n for n in range(1, 10_000) if far(2 * n + 1) > 0)
    lows, parts, spares = [], [], []
    while low <= largest:
        high = max(low + 1, int(low * GROWTH))
        d = far(2 * (high - 1))
        spare = round(0.08 * d)
        lows.append(low)
        parts.append(d + 1 + spare)
        spares.append(spare)
        low = high
    return np.array(lows, np.int64), np.array(parts, np.int64), np.array(spares, np.int64)


def members(size: np.ndarray, lows: np.ndarray, rule: links.Rule = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Set and band of every membership: own bands, and as guests those that begin at sizes that can be linked."""
    own = np.searchsorted(lows, size, "right") - 1
    last = np.searchsorted(lows, size * 100 // rule.percent, "right") - 1
    n = np.where(own >= 0, last - own + 1, np.maximum(last + 1, 0))
    who = np.repeat(np.arange(len(size)), n)
    return who, np.maximum(own, 0)[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)


def parts(values: np.ndarray, bounds: np.ndarray, rule: links.Rule = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of each set's sketches, end to end, and the n+1 bounds: sets that are linked, and not equal, share one."""
    size = np.diff(bounds)
    lows, many, spares = bands(int(size.max(initial=0)) * 100 // rule.percent, rule)
    who, band = members(size, lows, rule)
    n = size[who]
    at = np.repeat(bounds[:-1][who] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    of = np.repeat(np.arange(len(who)), n)
    h = words.mix(values[at] ^ _SEED[0])
    part = ((h >> np.uint64(32)) * many[band].astype(np.uint64)[of]) >> np.uint64(32)
    # a bit by membership, part and place; those flipped an even number of times are off
    cut = np.append(0, np.cumsum(many[band]))
    bit = np.sort(((cut[of].astype(np.uint64) + part) << np.uint64(9)) | (h & np.uint64(BITS - 1)))
    new = np.flatnonzero(np.append(True, bit[1:] != bit[:-1])) if len(bit) else np.zeros(0, np.int64)
    on = bit[new[np.diff(np.append(new, len(bit))) % 2 == 1]]
    place = (on >> np.uint64(9)).astype(np.int64)
    count = np.bincount(place, minlength=int(cut[-1]))
    said = np.zeros(int(cut[-1]), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        said[some] = np.add.reduceat(words.mix((on & np.uint64(BITS - 1)) + _SEED[1]), np.append(0, np.cumsum(count[some])[:-1]))
    owner = np.repeat(np.arange(len(who)), many[band])
    inside = np.arange(int(cut[-1])) - cut[owner]
    weak = count < WEAK
    told = ~weak | (np.bincount(owner, weights=weak, minlength=len(who)) > spares[band])[owner]
    key = words.mix(said ^ words.mix((band[owner].astype(np.uint64) << np.uint64(40)) + inside.astype(np.uint64) + _SEED[2]))[told]
    return key, np.append(0, np.cumsum(np.bincount(who[owner[told]], minlength=len(size))))


_SKETCH = "doc_id long, n_shingles long, print binary, keys array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in core.steps(batches):
        values, more, bounds = links.sets(core.text_of(piece.column("text")), RULE.shingle, both=True)
        n = np.diff(bounds)
        some = n > 0
        index = pa.array(np.cumsum(some) - 1, pa.int64(), mask=~some)
        told = np.ascontiguousarray(links.prints(values, more, bounds[:-1][some])) if some.any() else np.zeros((0, 2), np.uint64)
        prints = pa.Array.from_buffers(pa.binary(16), len(told), [None, pa.py_buffer(told)]).cast(pa.binary()).take(index)
        keys, cuts = parts(values, bounds)
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys.view(np.int64)))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), prints, lists], names=["doc_id", "n_shingles", "print", "keys"])


def _tied(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the smallest node of each, and each other node with that."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    head = node[first][np.cumsum(first) - 1]
    a, b = node[~first], head[~first]
    other = a != b
    return key[first], node[first], a[other], b[other]


_ROWS = "key long, a long, b long"


def _batch(key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    full = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([full(key), full(a), full(b)], names=["key", "a", "b"])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node), one a key for each FOLD of them, and ties (a, b) of nodes that share a key."""
    keys, nodes, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, head, a, b = _tied(np.concatenate(keys), np.concatenate(nodes))
        yield _batch(key, head, None)
        yield _batch(None, *_distinct(a, b))

    for batch in batches:
        lists = batch.column("keys")
        keys.append(np.asarray(lists.flatten()))
        nodes.append(np.repeat(np.asarray(batch.column("doc_id")), np.asarray(lists.value_lengths())))
        held += len(keys[-1])
        if held >= FOLD:
            yield from flush()
            keys, nodes, held = [], [], 0
    if held:
        yield from flush()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node: each tied to the first of its key, which may be in a batch before."""
    last = head = None
    for batch in batches:
        key, node = np.asarray(batch.column("key")), np.asarray(batch.column("a"))
        if not len(key):
            continue
        first = np.append(last is None or key[0] != last, key[1:] != key[:-1])
        heads = np.append(node[:1] if head is None else [head], node[first])
        mine = heads[np.cumsum(first)]
        last, head = key[-1], mine[-1]
        a, b = _distinct(node[node != mine], mine[node != mine])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `documents` (doc_id, text)."""
    scratch = core.Scratch(documents.sparkSession, "jaccard")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sketches = scratch.write(docs.mapInArrow(_sketches, _SKETCH), "sketches")
    some = sketches.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.write(some.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min_by("n_shingles", "doc_id").alias("n_shingles")), "classes")
    heads = scratch.write(some.select("print", "doc_id", "keys").join(classes.select("print", "doc_id"), ["print", "doc_id"]).select("print", "doc_id", "keys").filter("size(keys) > 0"), "class-keys")
    rows = scratch.write(heads.mapInArrow(_folded, _ROWS), "part-rows")
    stars = rows.filter("key is not null").select("key", "a").repartition("key").sortWithinPartitions("key", "a").mapInArrow(_stars, "a long, b long")
    edges = scratch.write(stars.unionByName(rows.filter("key is null").select("a", "b")), "candidate-edges")
    scratch.drop("part-rows")
    keys = heads.groupBy("doc_id").agg(F.first(F.slice("keys", 1, links.HEAD_KEYS)).alias("keys"))
    return links.resolve(docs, sketches.select("doc_id", "n_shingles", "print"), classes, edges, keys, RULE, scratch).select("doc_id", "n_shingles", "component_id")
