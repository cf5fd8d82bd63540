"""Costly work is dealt out by rows."""

from pyspark.sql import functions as F

from tidemark.plans import base


def test_spread_makes_tasks_by_rows(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    out = base.spread(d, 50)
    assert out.rdd.getNumPartitions() == 20
    assert out.count() == 1000
    assert max(out.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 60
