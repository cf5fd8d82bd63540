"""Connected components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Tables

#: Edges that one task joins in memory, before any round.
CHUNK = 1 << 18


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one chunk as stars: each node with the least one that it is joined with inside the chunk."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    kind = table.schema.field("u").type
    nodes, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in "uv"]), return_inverse=True)
    x, y = at[: table.num_rows], at[table.num_rows :]
    least = np.arange(len(nodes))
    while len(x):
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := least[least], least):
            least = up
        x, y = least[x], least[y]
        x, y = x[x != y], y[x != y]
    tied = np.flatnonzero(least != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied], kind), pa.array(nodes[least[tied]], kind)], names=["u", "v"])


def components(edges: DataFrame, seen: list[int] | None = None) -> DataFrame:
    """Rows (node, component): the least node that each node of the edges (a, b) is joined with. Nodes without edges are not told.

    Edges are dealt out in chunks of `CHUNK`, each of which becomes stars in memory; one chunk is the answer. Between chunks,
    large stars tie a node's larger neighbours to its least one, small stars its smaller neighbours; the rounds grow with the
    logarithm of what is joined, not with the length of a chain, and each is one written table of at most as many edges. The
    work of a hub is an aggregation and a join on it, so its edges are never one group in memory. `seen` gets the number of
    edges of each round.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    with Tables(edges.sparkSession, "components") as tables:
        now, turn, before = tables.write(edges, "edges"), 0, None
        chunks = max(1, -(-now.count() // CHUNK))
        now = tables.write(now.repartition(chunks).mapInArrow(_stars, now.schema), "0")
        while chunks > 1:
            turn += 1
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
            new = tables.write(small, str(turn))
            state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if seen is not None:
                seen.append(state[0])
            tables.drop(str(turn - 1))
            now = new
            if state == before:
                break
            before = state
        return tables.keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
