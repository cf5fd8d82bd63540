"""Every stage on its own input against brute force, and on odd tables."""

import base64
import re

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import quality

from . import cases
from .test_texts import ITEMS, RANKS, brute_components, brute_hits, hexed


def rows():
    """The cases, and rows that share an id: one a copy of another document, one of its own."""
    return [*cases.rows(), (21, cases.rows()[3][1]), (21, cases.prose(60, 90)), (21, cases.prose(61, 90)), (22, cases.prose(61, 90) + " end")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs = cases.documents(spark, rows(), extra=True)
    for name in ("__quality", "__row", "__own_0", "__turn"):
        docs = docs.withColumn(name, F.lit("mine"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 1), (3, 1), (11, 0), (10, 1), (15, 0)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


def whole(df):
    """Every row with every column."""
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


def expected(df, change):
    """What is left of the rows of `df` when `change` gives each row's new text, or None for a row that goes."""
    out = []
    for k, r in enumerate(sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))):
        new = change(k, r)
        if new is not None:
            out.append(tuple(sorted((r.asDict() | new).items())))
    return sorted(out, key=repr)


def test_near_duplicates_stage(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    out = pipeline.near_duplicates(spark, d, folder)
    assert out.columns == d.columns
    # each row a document of its own, in the order in which the smallest id stays
    order = [(r.doc_id, r.text) for r in sorted(d.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))]
    groups = {k: c for k, _, c, _ in brute_components([(k if i is not None else None, t) for k, (i, t) in enumerate(order)]) if k is not None}
    kept, seen = [], set()
    for k, (i, t) in enumerate(order):
        if i is None or groups[k] not in seen:
            seen.add(groups.get(k))
            kept.append((i, t))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(kept, key=repr)
    rest = whole(d)
    assert all(r in rest for r in whole(out))


def test_repeated_passages_stage(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    out = pipeline.repeated_passages(spark, d, folder)
    assert out.columns == d.columns
    words = re.compile(r"[^\x20\x09-\x0D]+")
    first = {}
    for i, t in rows():
        w = words.findall(t or "")
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)

    def change(_, r):
        w = words.findall(r.text or "")
        gone = {k + j for k in range(len(w) - 12) if r.doc_id is not None and first[tuple(w[k : k + 13])] < r.doc_id for j in range(13)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        return {"text": left, "n_chars": len(left)} if gone else {}

    assert whole(out) == expected(d, change)


def test_leaks_stage(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    out = pipeline.benchmark_leaks(spark, d, folder)
    assert out.columns == d.columns
    assert whole(out) == expected(d, lambda _, r: None if brute_hits([(r.doc_id, r.text)], ITEMS)[0][-1] else {})


def test_quality_stage(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    out = pipeline.quality_classifier(spark, d, folder)
    model = quality.fit(d, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {(r.doc_id, r.text): r.own_score for r in quality.score(d.select("doc_id", "text"), model, name="own_score").collect()}
    assert out.columns == d.columns and 0 < out.count() < d.count()
    assert whole(out) == expected(d, lambda _, r: {} if scores[r.doc_id, r.text] >= 0.5 else None)


def test_token_stage(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(r.doc_id, encoder.encode_ordinary(r.text or ""), hexed(r.text or "")) for r in d.collect()]
    got = [(r.doc_id, r.token_ids, r.decoded_sha256) for r in pipeline.tokens(spark, d, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_whole_run(spark, folder, sf):
    assert pipeline.run(spark, folder).count() > 0
    assert pipeline.run(spark, sf).count() > 100


def test_empty_documents(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, d, folder).count() == 0
