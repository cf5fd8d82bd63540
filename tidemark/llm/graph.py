"""Connected components of a distributed edge list: union-find in bounded chunks, then least labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

#: Edges that one task joins in memory.
CHUNK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some edges and the least node that each is joined with: larger roots go under smaller ones, all edges at once."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches if x.num_rows]
    if held:
        node, component = roots(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(component, pa.int64())], names=["node", "component"])


def components(edges: DataFrame, scratch: core.Scratch, name: str) -> DataFrame:
    """Rows (node, component): the smallest node reachable from each node of `edges` (a, b).

    The edges are dealt out in chunks of `CHUNK`, of which each becomes a forest of stars; if there is one chunk, that is the
    answer. Else rounds join the stars: each takes the least label among a node's neighbours and then the label of that
    label, and is written to the shared folder; only counts come to the driver. The edges of a hub and the members of a large
    component meet its label by a broadcast of such nodes alone (`core.attach`), so no task gets them all.
    """
    edges = scratch.write(edges.select("a", "b"), f"{name}-edges")
    chunks = max(1, -(-edges.count() // CHUNK))
    stars = edges.repartition(chunks).mapInArrow(_contract, "node long, component long")
    if chunks == 1:
        return scratch.write(stars, f"{name}-0")
    stars = stars.select(F.col("node").alias("a"), F.col("component").alias("b"))
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(both.distinct(), f"{name}-stars")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component"), F.count("*").alias("n")), f"{name}-0")
    nodes, turn = labels.count(), 0
    hubs = nodes > core.HOT and not labels.filter(F.col("n") > core.HOT).isEmpty()
    while True:
        turn += 1
        other = labels.select(F.col("node").alias("b"), "component", "n")
        near = (core.attach(both, other, "b") if hubs else both.join(other, "b")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", "n", F.least("component", "near").alias("via"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("then"))
        if nodes > core.HOT:  # only then can a component have so many members
            least = scratch.write(least, f"{name}-least-{turn}")
            jump = scratch.write(least.groupBy("via").agg(F.count("*").alias("m")).join(jump, "via"), f"{name}-jump-{turn}")
            least = core.attach(least, jump, "via", "m")
        else:
            least = least.join(jump, "via")
        new = scratch.write(least.select("node", F.least("via", "then").alias("component"), "n", "was"), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-least-{turn}", f"{name}-jump-{turn}")
        labels = new.drop("was")
        if new.filter("component <> was").isEmpty():
            return labels.drop("n")
