"""Queries of the corpus operators for the driver's catalogue: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, audit, bpe, core, decontaminate, jaccard, langid, minhash, oracles, quality, resample, substring, tokencount, toxicity, warc

#: The id the rank file leaves free.
EOD = 50256


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(core.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(core.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.report(core.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, EOD)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(core.documents(spark, sf_dir))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(core.documents(spark, sf_dir))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(core.documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(core.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(core.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(core.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(core.documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality, op2_warc, op3_token_counts, op4_minhash, op5_ann, op6_byte_bpe, op7_langid, op8_substring, op9_toxicity, op10_decontaminate, op11_filter_audit, op12_resample, op13_parity_join)}
ORACLES: dict[str, str] = {"op4_minhash": oracles.MINHASH, "op8_substring": oracles.SUBSTRING, "op10_decontaminate": oracles.DECONTAMINATE, "op11_filter_audit": oracles.AUDIT, "op12_resample": oracles.RESAMPLE, "op13_parity_join": oracles.JACCARD}
