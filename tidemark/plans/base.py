"""The driver's tables in the shape of filings: a company is a customer, a filing an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task of costly work takes.
SHARE = 25_000


def shares(df: DataFrame, share: int = SHARE) -> int:
    """So many tasks that each core has one and none takes much over `share` rows of a scan: a count of a file's rows reads its footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // share))


def spread(df: DataFrame, share: int = SHARE) -> DataFrame:
    """A scan dealt out for costly work by the row: to all cores, and to so many tasks that none takes much over `share` rows.

    A file packs a million short rows into a few megabytes, so the splits of a scan say nothing about the work in them.
    """
    tasks = shares(df, share)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


#: The same relation for DuckDB.
FILINGS = """f AS (SELECT o_orderkey AS order_id, o_custkey AS company_id, CASE WHEN o_orderkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, o_totalprice * 1e5 AS order_value_inr,
 CAST(o_orderdate AS TIMESTAMP) AS filed_at, substr(o_orderpriority, 3) AS order_type, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 0.8 WHEN '3' THEN 0.6 WHEN '4' THEN 0.4 ELSE 0.3 END AS firmness,
 o_orderstatus = 'P' AS is_amendment, CAST(o_orderkey % 36 + 1 AS DOUBLE) AS execution_months FROM orders)"""


def filings(spark: SparkSession, sf_dir: str, *, heavy: bool = False) -> DataFrame:
    """One order a filing, with firmness from its priority and months from its key (a stand-in for extracted fields)."""
    orders = table(spark, sf_dir, "orders")
    orders = spread(orders) if heavy else orders
    first = F.substring("o_orderpriority", 1, 1)
    firmness = F.when(first == "1", 1.0).when(first == "2", 0.8).when(first == "3", 0.6).when(first == "4", 0.4).otherwise(0.3)
    return orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("company_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "NSE").otherwise("BSE").alias("exchange"), (F.col("o_totalprice") * 1e5).alias("order_value_inr"),
        F.col("o_orderdate").cast("timestamp").alias("filed_at"), F.expr("substr(o_orderpriority, 3)").alias("order_type"), firmness.alias("firmness"),
        (F.col("o_orderstatus") == "P").alias("is_amendment"), (F.col("o_orderkey") % 36 + 1).cast("double").alias("execution_months"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("sector"), F.col("c_acctbal").alias("balance"))


def filing_text() -> Column:
    """The sentence a company would file, from an order's columns."""
    return F.format_string("The Company has received a work order from %s worth Rs. %.2f Lakh, to be executed within %d months.", "company_name", F.col("order_value_inr") / 1e5, F.col("execution_months").cast("int"))
