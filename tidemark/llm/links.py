"""Exact links between sets of word shingles inside candidate groups, and what they connect.

An operator brings rows (`described`: doc_id, the size of its set, a fingerprint), classes of equal sets, and candidate
edges that leave out no link. What is here holds every link against the full sets:

1. The components of the candidates hold every link inside. Each is split into tiles of bounded documents and shingles;
   a tile links its own exactly (prefix filter, then whole sets).
2. Components of several tiles (`across`): links between tiles are found by the same prefix filter as a shuffle. Shingles
   are ordered rare first. A link whose first common shingle is rare (in up to `RARE` documents of the component) is a pair
   in that shingle's short list. A link of common shingles only needs documents that are nearly all common; of those with
   equal common parts the smallest decides, and what is left meets in cells of like size that the bounds allow.
   Pairs that are one group already are left out, and every pair is confirmed on the full sets.

Texts travel once, to become sets. Nothing is capped or sampled: the one step that can grow faster than the rows is that
last meeting of documents made of nearly the same common shingles that are still linked with nothing in common (`cells`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core, graph, words

#: Documents and shingles in a tile.
TILE, TILE_SHINGLES = 1500, 1 << 20
#: Documents of a component up to which a shingle is rare.
RARE = 32
#: Keys of its operator by which the heads of tiles meet.
HEAD_KEYS = 4
_PRINT = np.random.default_rng(4_000_038).integers(0, 2**64 - 1, 2, np.uint64, endpoint=True)


@dataclass(frozen=True)
class Rule:
    """A set is the distinct runs of `shingle` words; a link has 100 * intersection >= percent * union."""

    shingle: int
    percent: int

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can be linked at all."""
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def linked(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of sizes a and b with so many shingles in common are linked."""
        return (both > 0) & (100 * both >= self.percent * (a + b - both))

    def prefixes(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of a set's rarest shingles must hold one of any linked set's: as the larger of the two, and as the smaller."""
        return size + 1 - -(-self.percent * size // 100), size + 1 - -(-2 * self.percent * size // (100 + self.percent))


def sets(texts: pa.Array, shingle: int, *, both: bool = False) -> tuple[np.ndarray, ...]:
    """The distinct shingle hashes of each text, ascending, end to end, and the n+1 bounds; with `both` their hashes of the second stream too."""
    data, offsets = core.bytes_of(texts)
    starts, ends, bounds = words.spans(data, offsets)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    full = np.flatnonzero(np.repeat(bounds[1:], n) - np.arange(len(doc)) >= shingle)
    short = np.flatnonzero((n > 0) & (n < shingle))
    owner = np.concatenate([doc[full], short])
    streams = []
    for stream in (0, 1) if both else (0,):
        word = words.hashes(data, starts, ends, fold=True, stream=stream)
        values = words.windows(word, shingle, stream)[full] if len(full) else np.zeros(0, np.uint64)
        one = [words.windows(word[bounds[i] : bounds[i + 1]], int(n[i]), stream)[0] + np.uint64(n[i]) for i in short]
        streams.append(np.concatenate([values, np.array(one, np.uint64)]))
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(n) + 1))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        part = order[i:j]
        order[i:j] = part[np.argsort(streams[0][part])]
    values, owner = streams[0][order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    out = [x[order][new] for x in streams]
    return *out, np.searchsorted(owner[new], np.arange(len(n) + 1))


def prints(values: np.ndarray, more: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A fingerprint of 128 bits of each of the sets that begin at `starts`, 64 of each stream."""
    return np.stack([np.add.reduceat(words.mix(x ^ p, k), starts) for k, (x, p) in enumerate(zip((values, more), _PRINT))], 1)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from rows sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            n = batch.num_rows
            differs = np.zeros(n, bool)
            for k in keys:
                differs |= np.asarray(batch.column(k)) != held[-1].column(k)[-1].as_py()
            cut = int(np.argmax(differs)) if differs.any() else n
            held.append(batch.slice(0, cut))
            if cut == n:
                continue
            yield pa.Table.from_batches(held)
            batch, held = batch.slice(cut), []
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            same &= np.asarray(batch.column(k)) == batch.column(k)[-1].as_py()
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def cuts_of(table: pa.Table, keys: list[str]) -> list[int]:
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        c = np.asarray(table.column(k))
        new[1:] |= c[1:] != c[:-1]
    return [0, *np.flatnonzero(new).tolist(), table.num_rows]


EDGES = "a long, b long"


def edge_batch(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


class Postings:
    """Lists of documents by shingle number, of some of the shingles of each."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.doc, self.bounds = doc[order], np.searchsorted(term[order], np.arange(n_terms + 1))

    def of(self, terms: np.ndarray) -> np.ndarray:
        first = self.bounds[terms]
        n = self.bounds[terms + 1] - first
        return self.doc[np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]


class Tile:
    """The sets of one tile, their shingles numbered rare first."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, rule: Rule):
        self.rule = rule
        self.n, self.size = len(bounds) - 1, np.diff(bounds)
        _, term, count = np.unique(values, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        doc = np.repeat(np.arange(self.n), self.size)
        order = np.lexsort((rank[term], doc))
        self.term, self.bounds = rank[term][order], bounds
        self.shared = np.zeros(self.n)
        np.add.at(self.shared, doc, count[term] / np.maximum(self.size, 1)[doc])
        place = np.arange(len(values)) - np.repeat(bounds[:-1], self.size)
        self.larger, self.smaller = rule.prefixes(self.size)
        lists = [Postings(self.term[w], doc[w], len(count)) for w in (place < np.repeat(k, self.size) for k in (self.larger, self.smaller))]
        self.as_larger, self.as_smaller = lists
        self.mark = np.zeros(len(count), bool)

    def linked(self, i: int, among: np.ndarray) -> np.ndarray:
        """The documents of the mask `among` that are linked with i."""
        own = self.term[self.bounds[i] : self.bounds[i + 1]]
        near = np.concatenate([self.as_smaller.of(own[: self.larger[i]]), self.as_larger.of(own[: self.smaller[i]])])
        near = np.unique(near[among[near]])
        near = near[self.rule.fits(self.size[near], self.size[i])]
        if not len(near):
            return near
        n = self.size[near]
        starts = np.append(0, np.cumsum(n)[:-1])
        at = np.repeat(self.bounds[near] - starts, n) + np.arange(n.sum())
        self.mark[own] = True
        both = np.add.reduceat(self.mark[self.term[at]].astype(np.int64), starts)
        self.mark[own] = False
        return near[self.rule.linked(both, n, self.size[i])]


def link_tile(values: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each set of a tile, and whether it is the most central of a group of two or more."""
    tile = Tile(values, bounds, rule)
    label, left = np.full(tile.n, -1), np.ones(tile.n, bool)
    for root in np.argsort(-tile.shared, kind="stable").tolist():
        if not left[root]:
            continue
        label[root], left[root], queue = root, False, [root]
        while queue and left.any():
            new = tile.linked(queue.pop(), left)
            label[new], left[new] = root, False
            queue += new.tolist()
    heads = np.zeros(tile.n, bool)
    heads[np.flatnonzero(np.bincount(label, minlength=tile.n) > 1)] = True
    return label, heads


def _sets_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint64), np.append(0, np.cumsum([len(b) // 8 for b in blobs])).astype(np.int64)


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(values).tobytes()
    return pa.array([raw[8 * i : 8 * j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())


_BY = ["sup", "tile"]
_LOCAL = "doc_id long, sup long, tiles long, tile long, local long, head boolean"


def _tile_links(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for table in runs(batches, _BY):
        cuts = cuts_of(table, _BY)
        for i, j in zip(cuts, cuts[1:]):
            part = table.slice(i, j - i)
            own = np.asarray(part.column("doc_id"))
            label, head = link_tile(*_sets_of(part.column("values")), rule)
            least = np.full(j - i, np.iinfo(np.int64).max)
            np.minimum.at(least, label, own)
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("doc_id", "sup", "tiles", "tile")), pa.array(least[label]), pa.array(head)], names=["doc_id", "sup", "tiles", "tile", "local", "head"])


def _tile_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each tile and how many of its documents have them."""
    for table in runs(batches, _BY):
        cuts = cuts_of(table, _BY)
        for i, j in zip(cuts, cuts[1:]):
            part = table.slice(i, j - i)
            term, n = np.unique(_sets_of(part.column("values"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), part.column(c)[0].as_py())) for c in _BY] + [pa.array(term.view(np.int64)), pa.array(n)], names=[*_BY, "term", "n"])


_PARTS = "core boolean, sup long, key long, doc_id long, group long, size long, common long, smaller boolean, values binary"


def _split(docs: pa.Table, common: pa.Table, rule: Rule) -> pa.Table:
    """A tile's rare prefix shingles, one row each, and its documents made of common shingles for the most part."""
    values, bounds = _sets_of(docs.column("values"))
    ids, group, sup = (np.asarray(docs.column(c)) for c in ("doc_id", "group", "sup"))
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(ids)), size)
    often = np.isin(values, np.asarray(common.column("term")).view(np.uint64))
    n_common = np.bincount(doc[often], minlength=len(ids))
    # rare shingles by value come first in the order of a document's shingles
    rare, owner = values[~often], doc[~often]
    place = np.arange(len(rare)) - np.searchsorted(owner, owner)
    larger, smaller = rule.prefixes(size)
    w = np.flatnonzero(place < larger[owner])
    o = owner[w]
    none = np.zeros(len(w), bool)
    post = [none, sup[o], rare[w].view(np.int64), ids[o], group[o], size[o], n_common[o], place[w] < smaller[o], pa.nulls(len(w), pa.binary())]
    c = np.flatnonzero((n_common > 0) & (100 * n_common >= rule.percent * size))
    mine = np.isin(doc, c) & often
    v, n = values[mine], n_common[c]
    cuts = np.append(0, np.cumsum(n))
    key = np.add.reduceat(words.mix(v ^ _PRINT[0]), cuts[:-1]) if len(c) else v
    core_rows = [np.ones(len(c), bool), sup[c], key.view(np.int64), ids[c], group[c], size[c], n, np.zeros(len(c), bool), _blobs(v, cuts)]
    names = ["core", "sup", "key", "doc_id", "group", "size", "common", "smaller", "values"]
    return pa.concat_tables([pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in rows], names=names) for rows in (post, core_rows)])


def _posting_pairs(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs of different groups in the list of a rare shingle, of up to RARE documents."""
    by = ["sup", "key"]
    for table in runs(batches, by):
        ids, group, size, smaller = (np.asarray(table.column(c)) for c in ("doc_id", "group", "size", "smaller"))
        cuts = np.array(cuts_of(table, by))
        n, a, b = np.diff(cuts), [], []
        for m in np.unique(n[n > 1]).tolist():  # all lists of one length at a time
            i, j = np.triu_indices(m, 1)
            at = cuts[:-1][n == m][:, None]
            a.append((at + i).ravel())
            b.append((at + j).ravel())
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            first = np.where(size[a] < size[b], smaller[a], np.where(size[a] > size[b], smaller[b], smaller[a] | smaller[b]))
            ok = (group[a] != group[b]) & rule.fits(size[a], size[b]) & first
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a[ok]], ids[b[ok]])), pa.array(np.maximum(ids[a[ok]], ids[b[ok]]))], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("left"), batch.column("right")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(bool(rule.linked(both, len(x), len(y))))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], names=["a", "b"])


def confirm(pairs: DataFrame, sets_of: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    side = lambda k, name: sets_of.select(F.col("doc_id").alias(k), F.col("values").alias(name))
    both = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")
    return both.select("a", "b", "left", "right").mapInArrow(lambda b: _confirm(b, rule), EDGES)


def _cell_links(probes: pa.Table, holders: pa.Table, rule: Rule) -> pa.Table:
    """Links by common shingles of the documents of one block with no larger ones of another."""
    a, b = [], []
    if probes.num_rows and holders.num_rows:
        (pv, pb), (hv, hb) = _sets_of(probes.column("values")), _sets_of(holders.column("values"))
        (pid, pg, ps), (hid, hg, hs) = ([np.asarray(t.column(c)) for c in ("doc_id", "group", "size")] for t in (probes, holders))
        terms = np.unique(hv)
        lists = Postings(np.searchsorted(terms, hv), np.repeat(np.arange(len(hid)), np.diff(hb)), len(terms))
        for i in range(len(pid)):
            mine = pv[pb[i] : pb[i + 1]]
            own = np.minimum(np.searchsorted(terms, mine), len(terms) - 1)
            both = np.bincount(lists.of(own[terms[own] == mine]), minlength=len(hid))
            to = np.flatnonzero(rule.linked(both, hs, ps[i]) & (hg != pg[i]) & (hs <= ps[i]))
            to = to[np.unique(hg[to], return_index=True)[1]]
            a += [int(pid[i])] * len(to)
            b += hid[to].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def cells(reps: DataFrame, rule: Rule, scratch: core.Scratch) -> DataFrame:
    """Links by common shingles between documents (sup, doc_id, group, size, common, values) of different groups.

    The smaller of two such is at least `percent` of the larger and at most what the larger's common shingles allow, so a
    document meets cells of sizes in between; a document of a component's largest group meets only those outside it.
    """
    count = scratch.write(reps.groupBy("sup", "group").agg(F.count("*").alias("k")), "core-groups")
    main = count.groupBy("sup").agg(F.max_by("group", F.struct("k", "group")).alias("main"), F.count("*").alias("groups"), F.sum("k").alias("n")).filter("groups > 1").drop("groups")
    main = scratch.write(main, "core-main")
    if main.isEmpty():
        return count.select(F.col("sup").alias("a"), F.col("sup").alias("b")).limit(0)
    rows = core.attach(reps, main, "sup").withColumn("inside", F.col("group") == F.col("main"))
    rows = scratch.write(rows, "core-rows")
    cell = lambda c: F.floor(F.log(c) / F.log(F.lit(1.1)))
    hold = rows.withColumn("cell", cell(F.col("size")))
    most = F.least(F.col("size"), F.floor(F.col("common") * (100 + rule.percent) / rule.percent) - F.col("size"))
    least = F.ceil(F.col("size") * rule.percent / 100)
    ask = rows.filter(most >= least).withColumn("cell", F.explode(F.sequence(cell(least), cell(most))))
    ask = ask.withColumn("side", F.explode(F.when(F.col("inside"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    by = ["sup", "cell", "side"]
    room = F.ceil(F.greatest(F.count("*") / TILE, F.sum("common") / TILE_SHINGLES)).cast("int")
    shape = hold.groupBy("sup", "cell", F.col("inside").alias("side")).agg(room.alias("blocks")).join(ask.groupBy(*by).agg(room.alias("chunks")), by)
    shape = scratch.write(shape, "core-shape")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    cols = ["doc_id", "group", "size", "values"]
    ask = ask.join(shape, by).select(*by, own("chunks").alias("chunk"), upto("blocks").alias("block"), *cols)
    hold = hold.withColumn("side", F.col("inside")).join(shape, by).select(*by, own("blocks").alias("block"), upto("chunks").alias("chunk"), *cols)
    by = [*by, "block", "chunk"]
    ask, hold = scratch.write(ask, "core-probes"), scratch.write(hold, "core-holders")
    return ask.groupBy(*by).cogroup(hold.groupBy(*by)).applyInArrow(lambda a, b: _cell_links(a, b, rule), EDGES)


def across(tiles: DataFrame, local: DataFrame, keys: DataFrame, rule: Rule, scratch: core.Scratch) -> DataFrame:
    """node, group of the documents of components of several tiles: `tiles` (doc_id, sup, tile, values), `local` the links inside tiles, `keys` (doc_id, keys)."""
    edges = local.select(F.col("doc_id").alias("a"), F.col("local").alias("b"))
    # heads of tiles that share a band key
    heads = local.filter("head").select("doc_id", "sup").join(keys, "doc_id")
    heads = scratch.write(heads.select("doc_id", F.explode(F.slice("keys", 1, HEAD_KEYS)).alias("key"), "sup").select("doc_id", F.xxhash64("sup", "key").alias("at")), "heads")
    first = scratch.write(heads.groupBy("at").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).filter("n > 1"), "first-heads")
    pairs = core.attach(heads, first, "at").filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    edges = scratch.write(edges.unionByName(confirm(pairs, tiles, rule)), "edges-heads")
    groups = graph.components(edges, scratch, "groups-heads").withColumnRenamed("node", "doc_id").withColumnRenamed("component", "group")

    # which shingles are common in their component, told to each tile
    terms = scratch.write(tiles.repartition(*_BY).sortWithinPartitions(*_BY).mapInArrow(_tile_terms, "sup long, tile long, term long, n long"), "terms")
    common = terms.groupBy("sup", "term").agg(F.sum("n").alias("all")).filter(F.col("all") > RARE).select("sup", "term")
    common = terms.join(common, ["sup", "term"]).select("sup", "tile", "term")
    held = tiles.join(groups, "doc_id").select("sup", "tile", "doc_id", "group", "values")
    parts = scratch.write(held.groupBy(*_BY).cogroup(common.groupBy(*_BY)).applyInArrow(lambda a, b: _split(a, b, rule), _PARTS), "parts")
    scratch.drop("terms")
    cores = parts.filter("core").withColumn("part", F.xxhash64("sup", "key"))

    # pairs of a rare shingle; a document and the smallest one of the same common part
    by = ["sup", "key"]
    rare = parts.filter("NOT core").select("sup", "key", "doc_id", "group", "size", "smaller")
    pairs = rare.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda b: _posting_pairs(b, rule), EDGES)
    small = cores.groupBy("part").agg(F.min(F.struct("size", "doc_id", "group")).alias("s"), F.count("*").alias("n"))
    small = scratch.write(small.select("part", F.col("s.doc_id").alias("b"), F.col("s.size").alias("least"), F.col("s.group").alias("other"), "n"), "smallest")
    allows = F.col("common") * (100 + rule.percent) >= rule.percent * (F.col("size") + F.col("least"))
    star = core.attach(cores.select("part", F.col("doc_id").alias("a"), "group", "size", "common"), small, "part").filter(allows & (F.col("group") != F.col("other")))
    edges = scratch.write(edges.unionByName(confirm(pairs.unionByName(star.select("a", "b")).distinct(), tiles, rule)), "edges-pairs")
    groups = graph.components(edges, scratch, "groups-pairs")

    # of each common part and group the smallest document, against those of other common parts
    cores = cores.drop("group").join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group")), "doc_id")
    reps = cores.groupBy("sup", "part", "group").agg(F.min(F.struct("size", "doc_id", "common")).alias("s")).select("sup", "group", "s.*")
    reps = scratch.write(reps.join(cores.select("doc_id", "values"), "doc_id"), "representatives")
    late = scratch.write(cells(reps, rule, scratch), "edges-cells")
    return groups if late.isEmpty() else graph.components(edges.unionByName(late), scratch, "groups-cells")


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for piece in core.steps(batches):
        texts = core.text_of(piece.column("text")).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([pack(x) for x in texts], pa.binary())], names=["doc_id", "packed"])


def _unpack_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            values, bounds = sets(pa.array([unpack(row.column("packed")[0].as_py())], pa.large_binary()).cast(pa.large_string()), shingle)
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("doc_id", "sup", "tiles", "tile")), _blobs(values, bounds)], names=["doc_id", "sup", "tiles", "tile", "values"])


def resolve(docs: DataFrame, described: DataFrame, classes: DataFrame, edges: DataFrame, keys: DataFrame, rule: Rule, scratch: core.Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id and print of every row.

    `docs` (doc_id, text) are the texts, `described` (doc_id, n_shingles, print) a row for each of theirs, `classes` (print,
    doc_id, n, n_shingles) the rows of equal sets under their smallest id, `edges` (a, b) candidates among classes that
    connect whatever is linked, `keys` (doc_id, keys) some keys of each class that linked ones mostly share.
    """
    some = described.filter("doc_id is not null and n_shingles > 0")
    sups = graph.components(edges, scratch, "candidates").select(F.col("node").alias("doc_id"), F.col("component").alias("sup"))

    # the sets of the candidates, from their texts, each once, in tiles
    members = scratch.write(sups.join(classes.select("doc_id", "n_shingles"), "doc_id"), "members")
    room = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n_shingles") / TILE_SHINGLES)).cast("long")
    counts = scratch.write(members.groupBy("sup").agg(room.alias("tiles"), F.count("*").alias("n")), "counts")
    members = core.attach(members.select("doc_id", "sup").distinct(), counts, "sup").select("doc_id", "sup", "tiles", F.pmod(F.xxhash64("doc_id"), "tiles").alias("tile"))
    texts = docs.filter("doc_id is not null").mapInArrow(_compress, "doc_id long, packed binary")
    tiles = scratch.write(texts.join(members, "doc_id").mapInArrow(lambda b: _unpack_sets(b, rule.shingle), "doc_id long, sup long, tiles long, tile long, values binary"), "tiles")
    local = scratch.write(tiles.repartition(*_BY).sortWithinPartitions(*_BY).mapInArrow(lambda b: _tile_links(b, rule), _LOCAL), "local")
    found = local.filter("tiles = 1").groupBy("doc_id").agg(F.min("local").alias("component"))
    several = local.filter("tiles > 1")
    if not several.isEmpty():
        found = found.unionByName(across(tiles.filter("tiles > 1"), several, keys, rule, scratch).select(F.col("node").alias("doc_id"), "component"))
    found = scratch.write(found, "found")

    # ids with several sets are one node: their classes meet through them
    twice = some.groupBy("doc_id").agg(F.min(F.xxhash64("print")).alias("low"), F.max(F.xxhash64("print")).alias("high")).filter("low <> high").select("doc_id")
    twice = scratch.write(some.select("doc_id", "print").join(twice, "doc_id"), "twice")
    if not twice.isEmpty():
        by_id = twice.join(classes.select("print", F.col("doc_id").alias("b")), "print").select(F.col("doc_id").alias("a"), "b")
        edges = found.select(F.col("doc_id").alias("a"), F.col("component").alias("b")).unionByName(by_id)
        found = graph.components(edges, scratch, "found").withColumnRenamed("node", "doc_id")

    # a class's component, then each document's through its class
    by_class = scratch.write(classes.select("print", "doc_id", "n").join(found, "doc_id", "left").select("print", F.coalesce("component", "doc_id").alias("component_id"), "n"), "by-class")
    in_class = core.attach(some.select("doc_id", "n_shingles", "print"), by_class, "print")
    alone = described.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", "print", F.col("doc_id").alias("component_id"))
    out = in_class.unionByName(alone)
    if twice.isEmpty():
        return out
    # an empty text of such an id belongs to the id's node too
    nodes = twice.select("doc_id").distinct().join(found, "doc_id").select("doc_id", "component")
    return out.join(nodes, "doc_id", "left").withColumn("component_id", F.coalesce("component", "component_id")).drop("component")
