"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN = "tidemark.own.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``; where that is unset, a temporary folder of a local session only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(_OWN, conf)
    return conf.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: a short lineage that any executor can read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by its own file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the time of a block; afterwards each is as it was, unset if it was unset."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Tables:
    """Written tables of one piece of work, in a folder of their own: dropped one by one, or all at the end of a block that fails.

    What a block returns may still read some: `keep` lets those stay, until the shared folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.kept = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", False

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None or not self.kept:
            self.drop("")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept = True
        return df

    def drop(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}".rstrip("/"))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
