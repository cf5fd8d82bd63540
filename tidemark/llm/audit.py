"""Audit of how filters interact: what each would remove in every order, kept up by a stream that takes back what it said.

Five filters fail a text: A under `least_words` words, B too few distinct words, C too many capitals, D a symbol of markup,
E the same text in a document of a smaller id. A to D are of the text alone. E is not: it can turn when another file comes.

1. A stream takes the files of the table as available-now micro-batches, a share of the files each. A task turns its texts
   into a mask of failures and a key of 128 bits, and texts go no further. Labels are joined by id.
2. Before rows are dealt out by key, each Arrow batch is folded: of the rows of a key those of its smallest id are counted
   without E and go on to the key's state; all others fail E for good and are only counted. A text that a third of all
   rows share is so a row or so for each 10,000.
3. The state holds for each key its smallest id so far and what that was counted as. A smaller id that comes later takes
   its place, and the count of the one before it is retracted (minus one at its mask, plus one at its mask with E); a
   larger one is retracted itself. The stream writes signed counts of (part, mask, labels) with its own log of batches, so
   a batch that is run again counts once. Keys are kept by buckets of some `PER_BUCKET` (by their hash; their number grows
   with the table), for a call for each key costs some 3 ms and a call for a bucket little more.
4. The sums of those are at most 32 masks times 4 pairs of labels a part. Every figure of every order follows from them.

State grows with distinct texts (some 30 bytes each) and is logged to the shared checkpoint folder, from which lost executors
load it. It is held as the session's `spark.sql.streaming.stateStore.providerClass` says: in memory as Spark comes, which a
cluster whose state outgrows its executors should set to RocksDB. The label table is read once for each of the `batches` micro-batches.

Defined cases: null text is empty (no words: fails A, and not B to D); a null lang is the part of the empty string. A null
doc_id is smaller than none and larger than none: it never fails E and makes none fail it, and has no labels. Rows that
share a doc_id are rows of their own; if theirs is the smallest, none of them fails E. A doc_id with several labels has
each that one of them gives. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import exists
from . import core, words

LETTERS = "ABCDE"
#: Bit of the filter that depends on other rows.
SAME = 1 << LETTERS.index("E")
#: Micro-batches in which a table is taken.
BATCHES = 4
#: Rows of the table for each bucket of keys.
PER_BUCKET = 4096


@dataclass(frozen=True)
class Limits:
    """When a text fails."""

    least_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 3
    symbols: str = "#$%&*|"


def failures(texts: pa.Array, limits: Limits = Limits()) -> np.ndarray:
    """Mask of A to D of each text."""
    data, offsets = core.bytes_of(texts)
    starts, ends, bounds = words.spans(data, offsets)
    value = words.hashes(data, starts, ends)
    n = np.diff(bounds)
    distinct = np.zeros(len(n), np.int64)
    for k in np.flatnonzero(n).tolist():
        own = np.sort(value[bounds[k] : bounds[k + 1]])
        distinct[k] = 1 + np.count_nonzero(own[1:] != own[:-1])

    def each(of: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(of, dtype=np.int64))[offsets])

    capitals, points = each((data >= 0x41) & (data <= 0x5A)), each((data & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(limits.symbols.encode())] = True
    tests = (n < limits.least_words, 100 * distinct < limits.distinct_percent * n, 100 * capitals > limits.capital_percent * points, each(symbol[data]) > 0)
    return sum(t.astype(np.int64) << k for k, t in enumerate(tests))


_FACTS = "doc_id long, part string, mask int, k1 long, k2 long"


def _facts(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    for piece in core.steps(batches):
        texts = core.text_of(piece.column("text"))
        data, offsets = core.bytes_of(texts)
        raw = memoryview(np.ascontiguousarray(data))
        keys = b"".join(hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        k = np.frombuffer(keys, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pc.fill_null(piece.column("lang"), ""), pa.array(failures(texts, limits), pa.int32()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], names=["doc_id", "part", "mask", "k1", "k2"])


_COUNTED = ["part", "mask", "good", "toxic"]
_DELTA = "part string, mask int, good boolean, toxic boolean, n long"
_KEPT = ["k1", "k2", "doc_id", *_COUNTED]
_FOLDED = f"bucket long, k1 long, k2 long, doc_id long, {_DELTA}"


def _summed(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    return rows.groupby(by, as_index=False, sort=False)["n"].sum()


def _least(rows: pd.DataFrame) -> pd.Series:
    """Whether a row has the smallest id of its key."""
    return rows.groupby(["k1", "k2"], sort=False)["doc_id"].transform("min") == rows.doc_id


def _fold(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for the states of texts, and counts, which have no doc_id and a bucket by what they count."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        rows["n"] = 1
        known = rows[rows.doc_id.notna()]
        first = _least(known)
        ahead = _summed(known[first], _KEPT)
        counted = _summed(pd.concat([rows[rows.doc_id.isna()], known[~first].assign(mask=known["mask"][~first] | SAME), ahead])[[*_COUNTED, "n"]], _COUNTED)
        ahead["bucket"] = ahead.k1 % buckets
        counted["bucket"] = [zlib.crc32(repr(r).encode()) % buckets for r in zip(*(counted[c] for c in _COUNTED))]
        out = pd.concat([ahead, counted.assign(k1=0, k2=0, doc_id=pd.array([None] * len(counted), "Int64"))])
        yield pa.RecordBatch.from_pandas(out[["bucket", *_KEPT, "n"]], preserve_index=False, schema=_ARROW)


_ARROW = pa.schema([*((c, pa.int64()) for c in ("bucket", "k1", "k2", "doc_id")), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("n", pa.int64())])


def _settle(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts pass through; of a text the smallest id so far stays counted without E, and any other that was is retracted."""
    rows = pd.concat(list(parts))
    counts = rows[rows.doc_id.isna()][[*_COUNTED, "n"]]
    rows = rows[rows.doc_id.notna()][[*_KEPT, "n"]].astype({"doc_id": "int64"})
    if len(rows):
        if state.exists:
            rows = pd.concat([pa.ipc.open_stream(bytes(state.get[0])).read_pandas(), rows])
        least = _least(rows)
        sink = pa.BufferOutputStream()
        held = pa.Table.from_pandas(_summed(rows[least], _KEPT), preserve_index=False)
        with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(held)
        state.update((sink.getvalue().to_pybytes(),))
        gone = rows[~least][[*_COUNTED, "n"]]
        counts = pd.concat([counts, gone.assign(n=-gone.n), gone.assign(mask=gone["mask"] | SAME)])
    counts = _summed(counts, _COUNTED)
    yield counts[counts.n != 0]


def _streamed(spark: SparkSession, path: str) -> str:
    """The path as a stream takes it: a folder as it is; a single file as a pattern that only it matches, for a stream's base must be a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory() else f"{path[:-1]}[{path[-1]}]"


def counters(spark: SparkSession, path: str, labels: DataFrame, *, limits: Limits = Limits(), batches: int = BATCHES) -> DataFrame:
    """part, mask, good, toxic, n: how many documents of the Parquet table at `path` fail just the filters of the mask."""
    scratch = core.Scratch(spark, "audit")
    table = spark.read.parquet(path)
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    told = scratch.write(labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic")), "labels")
    buckets = table.count() // PER_BUCKET + 1
    files = max(1, -(-len(table.inputFiles()) // batches))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(_streamed(spark, path))
    facts = stream.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).mapInArrow(lambda b: _facts(b, limits), _FACTS)
    known = facts.join(told, "doc_id", "left").select("k1", "k2", "doc_id", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    settled = known.mapInArrow(lambda b: _fold(b, buckets), _FOLDED).groupBy("bucket").applyInPandasWithState(_settle, _DELTA, "held binary", "append", GroupStateTimeout.NoTimeout)
    out = f"{scratch.base}/counts"
    query = settled.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{scratch.base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    deltas = spark.read.schema(_DELTA).parquet(out) if exists(spark, out) else spark.createDataFrame([], _DELTA)
    return deltas.groupBy(*_COUNTED).agg(F.sum("n").alias("n")).filter("n <> 0")


def orders(counted: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part's counters become three arrays of 32; all else is arithmetic on those, in the row.
    """
    masks = range(1 << len(LETTERS))
    tally = lambda cond, m: F.coalesce(F.sum(F.when((F.col("mask") == m) & cond, F.col("n"))), F.lit(0))
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    parts = counted.groupBy("part").agg(*[F.array(*[tally(cond, m) for m in masks]).alias(k) for k, cond in kinds.items()])
    plan = []
    for order in permutations(LETTERS):
        gone = 0
        for k, letter in enumerate(order):
            bit = 1 << LETTERS.index(letter)
            plan.append(("".join(order), k + 1, bit, gone))
            gone |= bit
    told = F.from_json(F.lit(json.dumps([{"filter_order": o, "step": k, "bit": b, "gone": g} for o, k, b, g in plan])), "array<struct<filter_order string, step int, bit int, gone int>>")
    rows = parts.withColumn("at", F.explode(told)).select("part", *kinds, "at.*")

    def over(kind: str, cond: str) -> F.Column:
        """Sum of a part's counts over the masks m of a condition."""
        return F.expr(f"aggregate(sequence(0, {len(masks) - 1}), 0L, (sum, m) -> sum + if({cond}, `{kind}`[m], 0L))")

    removed = "(m & bit) <> 0 and (m & gone) = 0"
    rows = rows.select(
        "part", "filter_order", "step", "bit", over("all", "(m & (bit | gone)) = 0").alias("kept"), over("all", removed).alias("removed"), over("all", "(m & bit) <> 0 and (m & gone) <> 0").alias("redundant"),
        F.element_at("all", F.col("bit") + 1).alias("unique_fails"), over("good", removed).alias("good_lost"), over("toxic", removed).alias("toxic_lost"),
    )
    shares = rows.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "bit"]).drop("bit")


def report(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """The audit of the table at `path`: a row for each part, order and step."""
    return orders(core.Scratch(spark, "audit-counters").write(counters(spark, path, labels), "counters"))
