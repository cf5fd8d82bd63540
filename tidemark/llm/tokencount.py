"""Token counts by separator scan over flat token files.

A token file is nothing but fixed-width little-endian ids, documents ended by an end-of-document id, without an index. It
is read in blocks, which cut documents anywhere. Each block is searched for the id in one vector step; a block then is its
token count and the places of its separators. A prefix scan over the blocks of a file (within runs of `RUN` blocks, then
over the runs, so no window holds more than a run or a file's runs) gives every block its first token's place, its first
document's number and where the document under way has begun, which stitches documents across blocks of any number.

`pack` makes such files from a table of texts, `read` takes files from a folder, `scan` and `stitch` are the operator.

Defined cases: null or empty text is a document of 0 tokens. Tokens after a file's last separator are a last document,
marked as not ended; an empty file has none. A file's length must be a whole number of ids (an error otherwise). Rows are
independent: repeated rows and null ids give a row each. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe, core

#: Tokens in a block, and blocks in a run of the prefix scan.
BLOCK, RUN = 1 << 20, 1024
FILES = "file string, block long, data binary, doc_ids array<long>"
SCANNED = "file string, block long, n long, ends array<long>, doc_ids array<long>"


def pack(docs: DataFrame, ranks_path: str, pattern: str, *, eod: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Flat token files of `docs` (doc_id, text) in blocks; doc_ids names the documents whose separator is in the block."""
    spark = docs.sparkSession
    core.ship(spark)
    ranks = bpe.read_ranks(ranks_path)
    if max(eod, *ranks.values()) > np.iinfo(np.dtype(dtype)).max or eod in ranks.values():
        raise ValueError("the separator must be an id of its own, and all ids must fit")
    sent = spark.sparkContext.broadcast((bpe.serialise(ranks), ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, file, number = bpe.Codec(*sent.value, dtype=dtype), f"part-{TaskContext.get().partitionId():06d}", 0
        stop, held, ids, ends, size, most = np.array([eod], dtype).tobytes(), [], [], [], 0, block * np.dtype(dtype).itemsize

        def cut() -> Iterator[pa.RecordBatch]:
            nonlocal held, ids, ends, size, number
            data = b"".join(held)
            at = 0
            while size - at >= most:
                here = sum(e <= at + most for e in ends)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file]), "block": pa.array([number], pa.int64()), "data": pa.array([data[at : at + most]], pa.binary()), "doc_ids": pa.array([ids[:here]], pa.list_(pa.int64()))})
                ids, ends, at, number = ids[here:], ends[here:], at + most, number + 1
            held, ends, size = [data[at:]], [e - at for e in ends], size - at

        for piece in core.steps(batches):
            for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                for part in codec.blocks(text or ""):
                    held.append(part)
                    size += len(part)
                held.append(stop)
                size += len(stop)
                ids.append(doc)
                ends.append(size)
                if size >= most:
                    yield from cut()
        if size:
            yield pa.RecordBatch.from_pydict({"file": pa.array([file]), "block": pa.array([number], pa.int64()), "data": pa.array([b"".join(held)], pa.binary()), "doc_ids": pa.array([ids], pa.list_(pa.int64()))})

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(run, FILES)


def read(spark: SparkSession, path: str, *, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Token files of a folder in blocks; a file must fit in a task (shards of up to a few hundred MB)."""
    core.ship(spark)
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content")):
                data = memoryview(content.as_buffer())
                if len(data) % width:
                    raise ValueError(f"{file}: not a whole number of ids")
                for k in range(0, -(-len(data) // (block * width))):
                    part = bytes(data[k * block * width : (k + 1) * block * width])
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([part], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["file", "block", "data", "doc_ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FILES)


def scan(files: DataFrame, *, eod: int, dtype: str = "<u2") -> DataFrame:
    """Of each block its number of tokens and the places of its separators."""
    core.ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                tokens = np.frombuffer(b.column("data")[k].as_buffer(), dtype)
                yield pa.RecordBatch.from_arrays([b.column("file").slice(k, 1), b.column("block").slice(k, 1), pa.array([len(tokens)], pa.int64()), pa.array([np.flatnonzero(tokens == eod)], pa.list_(pa.int64())), b.column("doc_ids").slice(k, 1)], names=["file", "block", "n", "ends", "doc_ids"])

    return files.mapInArrow(run, SCANNED)


def stitch(scanned: DataFrame) -> DataFrame:
    """file, doc_index, start, n_tokens (without the separator), ended, doc_id (null where the file has no names)."""
    rows = scanned.withColumn("run", F.floor(F.col("block") / RUN)).withColumn("docs", F.size("ends").cast("long"))
    last = F.when(F.col("docs") > 0, F.element_at("ends", -1) + 1)
    within = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("before", F.coalesce(F.sum("docs").over(within), F.lit(0)))
    rows = rows.withColumn("open", F.max(F.col("at") + last).over(within))
    runs = rows.groupBy("file", "run").agg(F.sum("n").alias("r_n"), F.sum("docs").alias("r_docs"), F.max(F.col("at") + last).alias("r_last"))
    over = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("r_at", F.coalesce(F.sum("r_n").over(over), F.lit(0))).withColumn("r_before", F.coalesce(F.sum("r_docs").over(over), F.lit(0)))
    runs = runs.withColumn("r_open", F.coalesce(F.max(F.col("r_at") + F.col("r_last")).over(over), F.lit(0)))
    runs = runs.withColumn("last_run", F.max("run").over(W.partitionBy("file"))).select("file", "run", "r_at", "r_before", "r_open", "last_run")
    rows = rows.join(runs, ["file", "run"])
    at = F.col("r_at") + F.col("at")
    begun = F.coalesce(F.col("r_at") + F.col("open"), F.col("r_open"))
    ends = rows.select("file", at.alias("at"), begun.alias("begun"), (F.col("r_before") + F.col("before")).alias("first"), "ends", "doc_ids", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("begun")).otherwise(F.col("at") + F.element_at("ends", F.col("k")) + 1)
    named = F.when(F.col("doc_ids").isNotNull(), F.try_element_at("doc_ids", F.col("k") + 1))
    done = ends.select("file", (F.col("first") + F.col("k")).alias("doc_index"), start.alias("start"), (F.col("at") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"), named.alias("doc_id"))
    tail = rows.filter(F.col("run") == F.col("last_run")).groupBy("file").agg(F.max(F.struct("block", at.alias("at"), "n", F.coalesce(F.col("r_at") + F.col("at") + last, begun).alias("begun"), (F.col("r_before") + F.col("before") + F.col("docs")).alias("index"))).alias("t"))
    left = F.col("t.at") + F.col("t.n") - F.col("t.begun")
    rest = tail.filter(left > 0).select("file", F.col("t.index").alias("doc_index"), F.col("t.begun").alias("start"), left.alias("n_tokens"), F.lit(False).alias("ended"), F.lit(None).cast("long").alias("doc_id"))
    return done.unionByName(rest)


def report(documents: DataFrame, ranks_path: str, pattern: str, eod: int) -> DataFrame:
    """doc_id, n_tokens of every document, found by scanning the token files the documents are packed into."""
    scratch = core.Scratch(documents.sparkSession, "tokencount")
    scanned = scratch.write(scan(pack(documents, ranks_path, pattern, eod=eod), eod=eod), "scanned")
    return stitch(scanned).select("doc_id", "n_tokens")
