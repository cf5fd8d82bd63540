"""Substring dedup by difference-cover anchors.

A word window of `WIDTH` words is removed where the same words also start in a document of a smaller id. Comparing every
window of the corpus would shuffle a hash for each word. Instead windows of `ANCHOR` words are hashed only at positions
whose remainder modulo `PERIOD` is in a difference cover: whatever the two starts of an equal run of WIDTH words are, some
shift below PERIOD puts both on the cover, so the two runs share an aligned anchor (ANCHOR + PERIOD - 1 = WIDTH). Only
windows around an anchor that two documents share are then compared in full, by 128 bits: two hashes of other keys and
mixers, each over all bytes of the words.

Shape of the work, in blocks of documents that are written once to the shared folder:

1. each block sends a row for each of its distinct anchor hashes; sorted by hash they are read as a stream, and those that
   another document has too go back to their blocks (a hash of a third of all documents is one row a block);
2. each block grows the shared anchors to the windows that hold them and sends a row for each distinct window with the
   block's smallest id for it; sorted by hash and id, those behind a smaller id go back;
3. each block marks the words and rewrites its texts.

No pair of documents is ever formed and no group is held: a task keeps one batch of a sorted stream, or one block, however
large the corpus and however common a hash. Rows grow with the corpus alone; nothing is collected to the driver.

Defined cases: null text has no words; a document of under WIDTH words loses none. Rows with the same doc_id are one
document: what only they share stays. A row with a null doc_id takes no part and stays as it is. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, words

WIDTH, PERIOD, ANCHOR = 13, 7, 7
#: Differences of these remainders modulo PERIOD are all of 0..6.
COVER = np.isin(np.arange(PERIOD), [0, 1, 3])
#: Text bytes in a block.
BLOCK_BYTES = 4 << 20
_ID, _TEXT = "__tm_id", "__tm_text"
_NONE = np.zeros(0, np.int64)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def blocks(df: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of `df` packed into compressed blocks: block, rows. Block numbers are drawn, so the result is to be written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"block": pa.array([uuid.uuid4().int >> 65], pa.int64()), "rows": pa.array([_pack(batch)], pa.binary())})

        for piece in core.steps(batches, _TEXT):
            held.append(piece)
            size += piece.nbytes
            if size >= block_bytes:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return df.mapInArrow(run, "block long, rows binary")


class Block:
    """One block unpacked: words, their hashes, and the ids of the documents they are in."""

    def __init__(self, blob: bytes):
        self.rows = _unpack(blob)
        self.data, offsets = core.bytes_of(core.text_of(self.rows.column(_TEXT)))
        self.starts, self.ends, self.bounds = words.spans(self.data, offsets)
        ids = self.rows.column(_ID).combine_chunks()
        lens = np.diff(self.bounds)
        self.known = np.repeat(np.asarray(ids.is_valid()), lens)
        self.ids = np.repeat(np.asarray(ids.fill_null(0)).astype(np.int64), lens)
        self.place = np.arange(len(self.starts)) - np.repeat(self.bounds[:-1], lens)
        self.left = np.repeat(self.bounds[1:], lens) - np.arange(len(self.starts))
        self.hash = words.hashes(self.data, self.starts, self.ends)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions on the cover, and the hash of the anchor at each."""
        at = np.flatnonzero(COVER[self.place % PERIOD] & (self.left >= ANCHOR) & self.known)
        return at, words.windows(self.hash, ANCHOR)[at] if len(at) else np.zeros(0, np.uint64)

    def candidates(self, at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows that hold a shared anchor on the cover, with two hashes of 64 bits."""
        near = np.zeros(len(self.starts) + PERIOD, bool)
        near[at[shared]] = True
        any_near = near[: len(self.starts)].copy()
        for k in range(1, PERIOD):
            any_near |= near[k : k + len(self.starts)]
        w = np.flatnonzero(any_near & (self.left >= WIDTH) & self.known)
        if not len(w):
            return w, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        other = words.hashes(self.data, self.starts, self.ends, stream=1)
        return w, words.windows(self.hash, WIDTH)[w], words.windows(other, WIDTH, 1)[w]


class Distinct:
    """Sorted distinct keys of 64 or 128 bits; `which` gives each entry its place among them."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None = None):
        order = np.argsort(a, kind="stable")
        s = a[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        if b is not None:
            t = b[order]
            if np.any(~new[1:] & (t[1:] != t[:-1])):  # one 64-bit hash, two windows
                order = np.lexsort((b, a))
                s, t = a[order], b[order]
                new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        self.order, self.first = order, np.flatnonzero(new)
        self.a, self.b = s[self.first], None if b is None else t[self.first]
        self.which = np.empty(len(s), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def least(self, x: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(x[self.order], self.first) if len(self.first) else x[:0]

    def most(self, x: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(x[self.order], self.first) if len(self.first) else x[:0]


_ANCHORS, _WINDOWS = "hash long, block long, twice boolean", "a long, b long, id long, block long, place int"


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], names=list(columns))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by hash, those in two documents or more: block, hash. One row waits for the next batch."""
    held = None
    for batch in batches:
        new = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("hash", "block", "twice")]
        h, block, flag = (np.concatenate(x) for x in zip(held, new)) if held else new
        if len(h):
            flag, same = flag.copy(), h[1:] == h[:-1]
            flag[1:] |= same
            flag[:-1] |= same
            held = [h[-1:], block[-1:], flag[-1:]]
            yield _batch(block=block[:-1][flag[:-1]], hash=h[:-1][flag[:-1]])
    if held:
        h, block, flag = held
        yield _batch(block=block[flag], hash=h[flag])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by hash and id, those whose first row has a smaller id: block, place. Of the run at hand only its key and id are kept."""
    key, least = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, ids, block, place = (np.asarray(batch.column(c)) for c in ("a", "b", "id", "block", "place"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = key != (a[0], b[0])
        first = np.append(np.int64(least), ids[new])[np.cumsum(new)]
        key, least = (a[-1], b[-1]), first[-1]
        flag = first < ids
        yield _batch(block=block[flag], place=place[flag])


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, n_removed, kept_text and kept_sha256 in place of any columns of those names."""
    spark = docs.sparkSession
    scratch = core.Scratch(spark, "substring")
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())]
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(doc_id).cast("long").alias(_ID), F.col(text).alias(_TEXT))
    # the text travels once: under _TEXT, and gets its name back at the end
    base = base.drop(text) if text in kept else base
    rows = scratch.write(blocks(base, block_bytes), "blocks")

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("rows")):
                b = Block(blob.as_buffer())
                at, a = b.anchors()
                d = Distinct(a)
                yield _batch(hash=d.a, block=np.full(len(d.a), block), twice=d.least(b.ids[at]) != d.most(b.ids[at]))

    first = rows.mapInArrow(send_anchors, _ANCHORS).repartition("hash").sortWithinPartitions("hash").mapInArrow(_shared, "block long, hash long")
    first = scratch.write(first, "anchors")

    def windows(b: Block, shared: pa.Table) -> tuple[np.ndarray, Distinct, np.ndarray]:
        at, a = b.anchors()
        w, *h = b.candidates(at, np.isin(a, np.asarray(shared.column("hash")).view(np.uint64)))
        d = Distinct(*h)
        return w, d, d.least(b.ids[w])

    def send_windows(left: pa.Table, shared: pa.Table) -> pa.Table:
        b = Block(left.column("rows")[0].as_buffer()) if shared.num_rows else None
        if b is None:
            return pa.Table.from_batches([_batch(a=_NONE, b=_NONE, id=_NONE, block=_NONE, place=_NONE.astype(np.int32))])
        _, d, least = windows(b, shared)
        n = len(d.a)
        return pa.Table.from_batches([_batch(a=d.a, b=d.b, id=least, block=np.full(n, left.column("block")[0].as_py()), place=np.arange(n, dtype=np.int32))])

    sent = rows.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(send_windows, _WINDOWS)
    second = scratch.write(sent.repartition("a", "b").sortWithinPartitions("a", "b", "id").mapInArrow(_later, "block long, place int"), "windows")

    out_schema = T.StructType([f for f in base.schema.fields if f.name != _ID] + added)

    def rewrite(left: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(left.column("rows")[0].as_buffer())
        later = np.asarray(answers.column("later"))
        w, d, least = windows(b, answers.filter(pa.array(~later)))
        behind = np.zeros(len(d.a), bool)
        behind[np.asarray(answers.column("hash"))[later]] = True
        gone = np.zeros(len(b.starts) + 1, np.int64)
        hit = w[behind[d.which] | (b.ids[w] > least[d.which])]
        np.add.at(gone, hit, 1)
        np.subtract.at(gone, hit + WIDTH, 1)
        drop = np.cumsum(gone)[:-1] > 0
        raw, n_words, n_removed, texts, digests = b.data.tobytes(), np.diff(b.bounds), [], [], []
        spots = np.stack([b.starts, b.ends], 1)
        for i, j in zip(b.bounds[:-1], b.bounds[1:]):
            lost = int(drop[i:j].sum())
            kept_words = b" ".join([raw[s:e] for s, e in (spots[i:j][~drop[i:j]] if lost else spots[i:j]).tolist()])
            n_removed.append(lost)
            texts.append(kept_words)
            digests.append(hashlib.sha256(kept_words).hexdigest())
        table = b.rows.drop_columns([_ID])
        new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests)]
        return pa.Table.from_arrays([*table.columns, *new], names=out_schema.names)

    # a window's place goes in the column of the hash
    both = first.withColumn("later", F.lit(False)).unionByName(second.select("block", F.col("place").cast("long").alias("hash"), F.lit(True).alias("later")))
    out = rows.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(rewrite, out_schema)
    return out.select(*[F.col(_TEXT).alias(text) if c == text else F.col(f"`{c}`") for c in kept], *[f.name for f in added])


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return deduplicate(documents.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
