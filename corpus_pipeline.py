"""From documents to token ids: quality, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of their docs; extra columns pass through, whatever their names. Rows with a
null doc_id or text go through the same stages; they cannot be duplicates of anything and are kept unless rejected. Rows
that share a doc_id are rows of their own: of those, only such go as resemble a row that stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, core, decontaminate, minhash, quality, substring


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns of these names renamed out of an operator's way, and the names to give back."""
    own = {_fresh(docs, f"__own_{k}"): c for k, c in enumerate(docs.columns) if c.lower() in names}
    for new, old in own.items():
        docs = docs.withColumnRenamed(old, new)
    return docs, own


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _fresh(docs, "__quality")
    return quality.score(docs, model, name=score).filter(F.col(score) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one of the smallest doc_id, of equal ones the first as written."""
    scratch = core.Scratch(spark, "pipeline-near")
    row = _fresh(docs, "__row")
    docs_by_row = scratch.write(docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    ids = docs_by_row.select(F.col(row).alias("row"), F.col("doc_id").alias("id")).filter("row is not null")
    groups = minhash.components(docs_by_row.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    kept = groups.join(ids, "row").groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("first.row").alias(row))
    some = docs_by_row.join(kept, row, "left_semi").unionByName(docs_by_row.filter(F.col(row).isNull()))
    return some.select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document of a smaller id has too go; the rest of the text stays, joined by spaces."""
    own_docs, own = _aside(docs, "n_words", "n_removed", "kept_text", "kept_sha256")
    out = substring.deduplicate(own_docs)
    changed = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    out = out.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))).drop("n_words", "n_removed", "kept_text", "kept_sha256")
    for new, old in own.items():
        out = out.withColumnRenamed(new, old)
    return out.select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    own_docs, own = _aside(docs, "n_words", "n_hit", "n_items", "items_sha256", "item_ids", "contaminated")
    out = decontaminate.search(own_docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = out.filter("not contaminated").drop("n_words", "n_hit", "n_items", "items_sha256", "item_ids", "contaminated")
    for new, old in own.items():
        out = out.withColumnRenamed(new, old)
    return out.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its token ids, their number, and digests of the ids and of the bytes they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs.select("doc_id", "text"), path, pattern, with_ids=True).drop("text")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

#: A classifier and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = core.Scratch(spark, "pipeline")
    docs = core.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
