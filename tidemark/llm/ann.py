"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on at most `SAMPLE` vectors (the first in the order of a hash of the id), and every vector is then put
into its leaf. A query walks the tree through a priority queue of nodes, each rated by what its vectors can reach: the inner
product with the centre plus the query's length times the spread (the root mean square distance from the centre). It visits
as many leaves as calibration asks for: on sample queries the number of visits is widened until the recall against brute
force over the sample reaches `RECALL`. If those leaves hold fewer than k candidates it goes on until they do.

Leaves are searched in blocks of at most `CHUNK` vectors by at most `QUERIES` queries, each a small matrix product whose
best are then scored again in double precision in a fixed order, so equal vectors get equal scores wherever they lie. A
vector that many rows share is scored once a block and its smallest ids stand for it, which leaves nothing out of the first k.

How much the bound on visits saves is a matter of the vectors: where they lie in clusters the share of leaves visited falls
as the table grows; where they are spread evenly over a sphere no order of leaves can tell neighbours from the rest, and
calibration then asks for most of the tree (README has figures).

Defined cases: rows with a null id, or a vector that is null, zero or holds null or non-finite components take no part. A
shorter vector counts as filled up with zeros. Rows that share a vec_id are rows of their own: each is a candidate for all
others and, where the id is a query's, a query. With fewer than k candidates a query gets them all, with none no row. Ties
go to the smaller vec_id. Empty table: empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import core

SAMPLE, BRANCHES, LEAF, ROUNDS = 20_000, 8, 64, 8
RECALL, PROBES = 0.97, 200
CHUNK, QUERIES = 4096, 2048


@dataclass
class Tree:
    """Node centres and spreads, each node's children (none: a leaf) and leaf number."""

    centre: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    visits: int = 1

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every node the nearest centre."""
        out, work = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            kids = self.children[node]
            if not len(rows):
                continue
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centre[kids]
            nearest = ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            work += [(kid, rows[nearest == k]) for k, kid in enumerate(kids)]
        return out

    def order(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        heap, length = [(0.0, 0)], np.linalg.norm(q)
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                yield self.leaf[node]
            else:
                for near, kid in zip((-(self.centre[kids] @ q) - length * self.spread[kids]).tolist(), kids):
                    heapq.heappush(heap, (near, kid))


def build(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF) -> Tree:
    rng = np.random.default_rng(5)
    tree, work = Tree(x.mean(0, keepdims=True), np.zeros(1), [[]], [-1]), [(0, np.arange(len(x)))]
    centres, spreads = [x.mean(0)], [0.0]
    n_leaves = 0
    while work:
        node, rows = work.pop()
        part = x[rows]
        own = None
        if len(rows) > leaf:
            c = part[rng.choice(len(rows), branches, replace=False)]
            for _ in range(ROUNDS):
                own = ((c**2).sum(1) - 2 * part @ c.T).argmin(1)
                size = np.bincount(own, minlength=branches)
                total = np.zeros_like(c)
                np.add.at(total, own, part)
                c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
            own = ((c**2).sum(1) - 2 * part @ c.T).argmin(1)
            if np.bincount(own, minlength=branches).max() == len(rows):  # copies of one vector
                own = None
        if own is None:
            tree.leaf[node] = n_leaves
            n_leaves += 1
            continue
        for k in np.unique(own).tolist():
            centres.append(c[k])
            spreads.append(float(np.sqrt(((part[own == k] - c[k]) ** 2).sum(1).mean())))
            tree.children.append([])
            tree.leaf.append(-1)
            tree.children[node].append(len(centres) - 1)
            work.append((len(centres) - 1, rows[own == k]))
    tree.centre, tree.spread = np.array(centres), np.array(spreads)
    return tree


def calibrate(tree: Tree, x: np.ndarray, k: int, target: float = RECALL, probes: int = PROBES) -> int:
    """Leaf visits at which the first k of `probes` of the rows are found with a mean recall of `target`."""
    if tree.leaves == 1 or len(x) < 2:
        return tree.leaves
    at = np.linspace(0, len(x) - 1, min(probes, len(x))).astype(int)
    leaf, k = tree.place(x), min(k, len(x) - 1)
    needed = np.empty((len(at), k), np.int64)
    for n, i in enumerate(at):
        s = x @ x[i]
        s[i] = -np.inf
        best = np.argpartition(-s, k - 1)[:k]
        turn = np.empty(tree.leaves, np.int64)
        turn[list(tree.order(x[i]))] = np.arange(tree.leaves)
        needed[n] = turn[leaf[best]] + 1
    ranked = np.sort(needed.ravel())
    return int(ranked[min(len(ranked) - 1, int(np.ceil(target * len(ranked))) - 1)])


def _vectors(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors as a matrix: of `width` columns, or as many as the longest has; zeros fill up, what is over is cut."""
    rows = column.to_pylist()
    lengths = {len(r) for r in rows}
    width = width or max(lengths, default=8) // 8
    if lengths != {8 * width}:
        rows = [r[: 8 * width].ljust(8 * width, b"\0") for r in rows]
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), width)


def _clean(embeddings: DataFrame) -> DataFrame:
    """row long, vec_id long, x binary (float64). Row numbers are drawn as rows are read, so the result is to be written once."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    v = v.filter(F.coalesce(fine, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, cuts = np.asarray(b.column("v").flatten()), np.append(0, np.cumsum(np.asarray(b.column("v").value_lengths()))).astype(int)
            x = [flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array(x, pa.binary())], names=["row", "vec_id", "x"])

    return v.mapInArrow(run, "row long, vec_id long, x binary")


_FOUND = "query long, row long, score double, vec_id long"


def best(asking: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k of one block of candidates (row, id, vector) for each of one block of queries (row, vector): query row, row, score, id."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    order = np.lexsort((rows, ids))
    rows, ids, x = rows[order], ids[order], np.ascontiguousarray(x[order])
    _, first, which = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
    groups = np.argsort(which, kind="stable")
    start = np.searchsorted(which[groups], np.arange(len(first)))
    size = np.diff(np.append(start, len(groups)))
    u = x[first]
    rough = q @ u.T
    take = min(k + 1, len(u))
    edge = -np.partition(-rough, take - 1, axis=1)[:, take - 1]
    slack = 1e-9 * np.maximum(np.linalg.norm(q, axis=1) * np.linalg.norm(u, axis=1).max(), 1e-300)
    ask, col = np.nonzero(rough >= (edge - slack)[:, None])
    exact = (q[ask] * u[col]).sum(1)
    n = np.minimum(size[col], k + 1)  # the smallest ids of a shared vector, and one more for the query itself
    at = groups[np.repeat(start[col], n) + np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)]
    ask, score = np.repeat(ask, n), np.repeat(exact, n)
    keep = rows[at] != asking[ask]
    ask, at, score = ask[keep], at[keep], score[keep]
    order = np.lexsort((at, -score, ask))
    ask, at, score = ask[order], at[order], score[order]
    near = np.arange(len(ask)) - np.searchsorted(ask, ask) < k
    return asking[ask[near]], rows[at[near]], score[near], ids[at[near]]


def search(embeddings: DataFrame, *, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each vector whose id is divisible by `every`."""
    spark = embeddings.sparkSession
    scratch = core.Scratch(spark, "ann")
    clean = scratch.write(_clean(embeddings), "vectors")
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = sample.column("x").to_pylist()
    width = Counter(map(len, lengths)).most_common(1)[0][0] // 8
    x = _vectors(sample.column("x"), width)
    tree = build(x)
    tree.visits = calibrate(tree, x, k, recall)
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = sent.value.place(_vectors(b.column("x"), width)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["row", "vec_id", "x", "leaf"])

    index = scratch.write(clean.mapInArrow(place, "row long, vec_id long, x binary, leaf long"), "index")
    held = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # at most a row for each leaf
        held[r["leaf"]] = r["count"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q in _vectors(b.column("x"), width) if b.num_rows else []:
                leaves, found = [], 0
                for leaf in sent.value.order(q):
                    if held[leaf]:
                        leaves.append(leaf)
                        found += held[leaf]
                        if len(leaves) >= sent.value.visits and found > k:
                            break
                out.append(leaves)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("x"), pa.array(out, pa.list_(pa.int64()))], names=["row", "x", "leaves"])

    queries = index.filter(F.col("vec_id") % every == 0)
    visits = queries.select("row", "x").mapInArrow(walk, "row long, x binary, leaves array<long>")
    visits = scratch.write(visits, "visits").select("row", "x", F.explode("leaves").alias("leaf"))
    asked = np.zeros(tree.leaves, np.int64)
    for r in visits.groupBy("leaf").count().collect():
        asked[r["leaf"]] = r["count"]
    shape = [(i, int(max(1, -(-h // CHUNK))), int(-(-a // QUERIES))) for i, (h, a) in enumerate(zip(held.tolist(), asked.tolist())) if a]
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shape = F.broadcast(spark.createDataFrame(shape, "leaf long, chunks int, blocks int"))  # a row for each leaf
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = visits.join(shape, "leaf").select("leaf", "row", "x", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), upto("chunks").alias("chunk"))
    held_by = index.join(shape, "leaf").select("leaf", "row", "vec_id", "x", F.pmod(F.xxhash64("row"), "chunks").cast("int").alias("chunk"), upto("blocks").alias("block"))
    by = ["leaf", "chunk", "block"]

    def look(asking: pa.Table, holding: pa.Table) -> pa.Table:
        names = ("query", "row", "score", "vec_id")
        if not asking.num_rows or not holding.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        row, own = (np.asarray(t.column("row")) for t in (asking, holding))
        got = best(row, _vectors(asking.column("x")), own, np.asarray(holding.column("vec_id")), _vectors(holding.column("x")), k)
        return pa.table(dict(zip(names, got)))

    found = asks.groupBy(*by).cogroup(held_by.groupBy(*by)).applyInArrow(look, _FOUND)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
