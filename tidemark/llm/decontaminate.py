"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Letters of the search are whole words. Windows of the benchmark items (`width` consecutive words, or a shorter item as
one) are the patterns. A block is the last few words of the position looked at: the shift table says how far the search
may skip, blocks that end a pattern lead through a suffix bucket and a prefix to candidate windows, and the words
themselves are compared before an occurrence counts.

Windows are held in blocks of at most `MOST` by a hash, so what a worker holds does not grow with the benchmark. A normal
benchmark is one block and one pass. With more, the documents are written once with a row number and searched once a
block; only row numbers, spans and item ids of rows with hits go on from there, and meet the documents at the end.

Defined cases: null or empty text has no words and no hits. An item without words has no window. Items with a null id count
for hits, and as one item, but have no id to list. Rows are independent: repeated documents give repeated results, repeated
items (same id) count once. A null doc_id stays null. Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

WIDTH = 10
#: Windows in one block of patterns.
MOST = 200_000
#: Word bytes 0-9, a-z after folding A-Z, and all of 0x80 and more; the rest becomes a space.
_TO = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def split(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO).split()


class Searcher:
    """Shift, suffix and prefix tables for windows of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]):
        self.length = len(next(iter(patterns)))
        self.block = min(3, self.length)
        self.rest = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for words, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.rest), self.length - end)
            by_prefix = self.bucket.setdefault(words[self.length - self.block :], {})
            by_prefix.setdefault(words[: self.block], []).append((words, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """Start and items of each occurrence."""
        at, n, block, length, rest, shift = self.length, len(words), self.block, self.length, self.rest, self.shift
        while at <= n:
            key = tuple(words[at - block : at])
            skip = shift.get(key, rest)
            if skip:
                at += skip
                continue
            start = at - length
            if found := self.bucket[key].get(tuple(words[start : start + block])):
                here = tuple(words[start:at])
                for pattern, items in found:
                    if pattern == here:
                        yield start, items
            at += 1


def patterns(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct (window, item) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = split(text)
                cut = [words] if 0 < len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
                for at in range(0, len(cut), 50_000):
                    part = [b" ".join(w) for w in cut[at : at + 50_000]]
                    yield pa.RecordBatch.from_pydict({"window": pa.array(part, pa.binary()), "item": pa.array([item] * len(part), pa.string())})

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    return items.mapInArrow(run, "window binary, item string").distinct()


def _finder(sent):
    """A function of a text: its number of words, and start, end, start, end, ... and items of the windows in it."""
    made: list[list[Searcher]] = []

    def find(text: str | None) -> tuple[int, list[int], set]:
        if not made:
            made.append([Searcher(p) for p in sent.value.values()])
        words = split(text)
        spots, items = [], set()
        for searcher in made[0]:
            for start, own in searcher.find(words):
                spots += (start, start + searcher.length)
                items.update(own)
        return len(words), spots, items

    return find


_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())]


def _columns(found: Iterator[tuple[int, list[int], set]]) -> list[pa.Array]:
    rows = []
    for n, spots, items in found:
        hit, end = 0, 0
        for a, b in sorted(zip(spots[::2], spots[1::2], strict=True)):
            hit += max(0, b - max(a, end))
            end = max(end, b)
        ids = sorted(i for i in items if i is not None)
        rows.append((n, hit, len(items), hashlib.sha256(",".join(ids).encode()).hexdigest(), ids, hit > 0))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.bool_()]
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


def search(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, most: int = MOST, text: str = "text") -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256, item_ids (sorted as strings) and contaminated."""
    spark = docs.sparkSession
    scratch = core.Scratch(spark, "decontaminate")
    rows = scratch.write(patterns(benchmark, width), "patterns")
    blocks = max(1, -(-rows.count() // most))

    def block(k: int):
        """The k-th block of windows, at most about `most`, sent to the workers."""
        held: dict[int, dict[tuple[bytes, ...], list]] = {}
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k)
        for window, item in part.collect():
            words = tuple(bytes(window).split())
            held.setdefault(len(words), {}).setdefault(words, []).append(item)
        return spark.sparkContext.broadcast(held)

    if blocks == 1:
        find = _finder(block(0))
        return core.append(docs, _FIELDS, lambda piece: _columns(map(find, piece.column(text).to_pylist())), text)

    number, spots, names = "__tm_row", "__tm_spots", "__tm_items"
    docs = scratch.write(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    hits = None
    for k in range(blocks):
        sent = block(k)
        part = scratch.write(_hits(docs.select(number, text), _finder(sent), number, text, spots, names), f"hits{k}")
        sent.unpersist()
        hits = part if hits is None else hits.unionByName(part)
    all_of = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = docs.join(hits.groupBy(number).agg(all_of(spots), all_of(names)), number, "left")

    def finish(piece: pa.RecordBatch) -> list[pa.Array]:
        texts, at, items = (piece.column(c).to_pylist() for c in (text, spots, names))
        return _columns((len(split(t)), a or [], set(i or [])) for t, a, i in zip(texts, at, items, strict=True))

    return core.append(found, _FIELDS, finish, text).drop(number, spots, names)


def _hits(df: DataFrame, find, number: str, text: str, spots: str, names: str) -> DataFrame:
    """Row number, spans and items of the rows that hold a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(n, *find(t)[1:]) for n, t in zip(batch.column(number).to_pylist(), batch.column(text).to_pylist(), strict=True)]
            got = [g for g in got if g[1]]
            kinds = {number: pa.int64(), spots: pa.list_(pa.int64()), names: pa.list_(pa.string())}
            columns = [[g[0] for g in got], [g[1] for g in got], [list(g[2]) for g in got]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], names=list(kinds))

    return df.mapInArrow(run, f"{number} long, {spots} array<long>, {names} array<string>")


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and what its text shares with the benchmark, for every document."""
    return search(documents.select(F.col("doc_id"), F.col("text")), benchmark).drop("text", "item_ids")
