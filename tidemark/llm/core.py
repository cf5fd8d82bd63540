"""Shared plumbing of the corpus operators: the shared folder, written tables, Arrow pass-through.

Nothing here collects rows to the driver. Lineage is cut by writing Parquet into the folder the session names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.base import spread
from ..shared import settings, shared_dir
from ..ship import ship

#: Text bytes that one numpy step works on; temporaries are about 40 times that.
STEP_BYTES = 1 << 20
#: Spark's setting that ends the shuffle files of a query with the query.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one operator call; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes `df` and reads it back; its shuffle files go as soon as it is written, for nothing reads them again."""
        path = f"{self.base}/{name}"
        with settings(self.spark, {_CLEAN: "true"}):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key that a shuffled join may bring together.
HOT = 1_000_000


def attach(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """`left` joined with `right`, which has one row a key and says in `n` how many rows of `left` have it; `n` goes.

    Keys of over `HOT` rows, at most one for each `HOT` rows of `left`, are broadcast; all others are shuffled, so no task
    gets more than `HOT` rows of a key. `right` should be a written table.
    """
    many = right.filter(F.col(n) > HOT)
    if many.isEmpty():
        return left.join(right.drop(n), key)
    few = left.join(F.broadcast(many.select(key)), key, "left_anti").join(right.filter(F.col(n) <= HOT).drop(n), key)
    return few.unionByName(left.join(F.broadcast(many.drop(n)), key))


def text_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of 64-bit-offset strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n+1 offsets of the texts in them."""
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about `limit` text bytes; a longer text is a piece of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def append(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list], text: str = "text", limit: int = STEP_BYTES) -> DataFrame:
    """`df` with columns that `fn` derives from pieces of its rows, every row and column kept, in one pass, no shuffle.

    A column of `df` whose name (in any case) is one of the new names gives way to the new one.
    """
    ship(df.sparkSession)
    new = {f.name.lower() for f in fields}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in steps(batches, text, limit):
            arrays = [a if isinstance(a, pa.Array) else pa.array(a) for a in fn(piece)]
            yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], names=[*piece.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a file of fewer splits than there are cores is dealt out to all of them."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % by
