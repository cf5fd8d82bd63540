"""Order statistics of trailing time windows, and last values carried forward, for keys of any number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import Tables

#: Rows that one numpy pass takes at least; a group is never cut.
PASS = 1 << 16
#: Rows of one key that a window may bring to one task.
HOT = 1_000_000


def kth(values: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of each range values[low:high] the element that is k-th (from 0) in order, all at once.

    A wavelet matrix that is built and asked level by level: at each bit of the ranks the values are parted, zeros first, and
    every range goes to the side that holds its k-th. Time is values + ranges for each bit, memory one level.
    """
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    low, high, k, found = low.copy(), high.copy(), k.copy(), np.zeros(len(low), np.int64)
    for bit in reversed(range(max(1, len(values) - 1).bit_length())):
        ones = (rank >> bit) & 1 == 1
        zeros = np.append(0, np.cumsum(~ones))
        a, b = zeros[low], zeros[high]
        right = k >= b - a
        k -= np.where(right, b - a, 0)
        low, high = np.where(right, zeros[-1] + low - a, a), np.where(right, zeros[-1] + high - b, b)
        found |= right.astype(np.int64) << bit
        rank = np.concatenate([rank[~ones], rank[ones]])
    return values[order[found]]


def medians(group: np.ndarray, at: np.ndarray, value: np.ndarray, counted: np.ndarray, asked: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and number of the counted values of the same group in [at - span, at) for each row of `asked`; rows are sorted by group and time."""
    base = int(at.min(initial=0))
    width = int(at.max(initial=0)) - base + 1
    place = group * width + (at - base)
    held, values = place[counted], value[counted]
    first = group[asked] * width
    low = np.searchsorted(held, np.maximum(place[asked] - span, first))
    high = np.searchsorted(held, place[asked])
    n = high - low
    out, some = np.full(len(n), np.nan), np.flatnonzero(n)
    if len(some):
        ends = [kth(values, low[some], high[some], x) for x in ((n[some] - 1) // 2, n[some] // 2)]
        out[some] = (ends[0] + ends[1]) / 2
    return out, n


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().dictionary_encode(null_encoding="encode").indices)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, of PASS rows and more, and the number of each row's group; rows come sorted by the keys."""

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for c in keys:
            codes = _codes(table.column(c))
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    held: list[pa.RecordBatch] = []
    due = PASS
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= due:
            table = pa.Table.from_batches(held)
            number = numbered(table)
            cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield table.slice(0, cut), number[:cut]
            held, due = table.slice(cut).to_batches(), max(PASS, 2 * (table.num_rows - cut))  # one large group is looked at again when it has doubled
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def trailing_median(rows: DataFrame, by: list[str], at: Column, value: Column, span: int, median: str, n: str) -> DataFrame:
    """`rows` with the median and the number of the values that others of their group have in the `span` seconds before theirs.

    Rows of the same second do not count, nor those whose `value` is null; a row without a time has none before it. Time is
    dealt to cells as long as the span, and a counted row goes to its own and the next one: so a cell has all that its rows
    look back on, a key of many years is many tasks, and no row carries an array. Cells are worked on by rank structures
    that take n log n.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    d = rows.select(own.alias("__row"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], at.cast("long").alias("__at"), value.cast("double").alias("__value"))
    cell = F.floor(F.col("__at") / span)
    both = F.when(F.col("__value").isNotNull() & F.col("__at").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.withColumn("__next", F.explode(both)).withColumn("__cell", cell + F.col("__next")).withColumn("__row", F.when(F.col("__next") == 0, F.col("__row"))).drop("__next")
    keys = [*(f"__k{i}" for i in range(len(by))), "__cell"]
    schema = T.StructType([d.schema["__row"], T.StructField(median, T.DoubleType()), T.StructField(n, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _groups(batches, keys):
            own = np.asarray(table.column("__row").is_valid())
            time, value = table.column("__at"), table.column("__value")
            timed = np.asarray(time.is_valid())
            counted = np.asarray(value.is_valid()) & timed
            out, many = medians(group, np.asarray(time.fill_null(0)), np.asarray(value.fill_null(0.0)), counted, own, span)
            many = np.where(timed[own], many, 0)
            yield from pa.table({"__row": table.column("__row").filter(pa.array(own)), median: pa.array(out, mask=many == 0), n: pa.array(many, pa.int64())}).to_batches()

    out = d.repartition(*keys).sortWithinPartitions(*keys, "__at").mapInArrow(run, schema)
    kept = [c for c in rows.columns if c not in (median, n)]
    return out.select(*[F.col(f"__row.`{c}`") for c in kept], median, n)


def last_before(rows: DataFrame, key: str, order: list[str], value: str, hot: int | None = None) -> DataFrame:
    """`rows` with `__last`: the latest non-null `value` of their key at or before them in `order`.

    A window a key while no key has over `hot` rows. Beyond that the rows are dealt out by ranges of key and order, so a key
    is as many tasks as it has rows for; each range carries its own last values, and what a key brings into a range from
    those before is looked up in a second pass, in a table of one row for each end of a range.
    """
    most = HOT if hot is None else hot
    own = lambda *by: W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = lambda *by: F.last(value, ignorenulls=True).over(own(*by))
    if rows.groupBy(key).count().filter(F.col("count") > most).isEmpty():
        return rows.withColumn("__last", last(key))
    with Tables(rows.sparkSession, "carried") as tables:
        dealt = tables.write(rows.repartitionByRange(key, *order, F.xxhash64(*rows.columns)).withColumn("__part", F.spark_partition_id()), "dealt")
        # a key that ends a range and goes on in another: at most one for each end
        parts = dealt.groupBy(key, "__part").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("__v")))).alias("__end"))
        spans = parts.join(parts.groupBy(key).count().filter("count > 1").select(key), key)
        before = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
        carried = tables.write(spans.select(key, "__part", F.last("__end.__v", ignorenulls=True).over(before).alias("__carried")).filter("__carried IS NOT NULL"), "ends")
        out = dealt.withColumn("__last", last("__part", key)).join(F.broadcast(carried), [key, "__part"], "left")
        return tables.keep(out.withColumn("__last", F.coalesce("__last", "__carried")).select(*rows.columns, "__last"))
