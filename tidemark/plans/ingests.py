"""Ingest queries: feeds rendered from the tables, normalised, keyed, de-duplicated, classified."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..shared import shared_dir
from ..sources import landed
from ..streaming import ingest
from . import base

Q: dict = {}
O: dict[str, str] = {}


#: Orders of whose filings one task joins, renders or sorts the rows.
SORTED = 100_000


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


def _bse(spark, sf, tasks):
    """A feed with a targeted and a wide listing of the same records, rendered after its rows are dealt out by order: a company may have many."""
    f = base.filings(spark, sf).repartition(tasks, "company_id").join(base.companies(spark, sf).repartition(tasks, "company_id"), "company_id").repartition(tasks, "order_id")
    raw = f.select(F.concat(F.lit("N"), F.col("order_id").cast("string")).alias("NEWSID"), F.col("company_id").cast("string").alias("SCRIP_CD"), F.col("company_name").alias("SLONGNAME"), F.lit("Company Update").alias("CATEGORYNAME"), F.lit("-").alias("SUBCATNAME"), F.when(F.col("is_amendment"), "Cancellation of <b>order</b>").when(F.col("order_id") % 3 == 0, "Award &amp; receipt of order").otherwise("Outcome of meeting").alias("HEADLINE"), F.lit(None).cast("string").alias("NEWSSUB"), F.lit("").alias("MORE"), F.concat(F.col("order_id").cast("string"), F.lit(".pdf")).alias("ATTACHMENTNAME"), F.date_format("filed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("News_submission_dt"), F.lit(None).cast("string").alias("DT_TM"), F.lit(False).alias("targeted"))
    return landed.bse(raw.unionByName(raw.filter("CAST(substr(NEWSID, 2) AS BIGINT) % 5 = 0").withColumn("targeted", F.lit(True))))


def _tasks(spark, sf):
    """In how many tasks each step takes the feed: by rows, so that none of them grows with the table."""
    return base.shares(base.table(spark, sf, "orders"), SORTED)


def _once(spark, sf):
    """The feed with one row a filing."""
    tasks = _tasks(spark, sf)
    return landed.once(_bse(spark, sf, tasks), tasks)


@query("SELECT sha1('BSE|N' || o_orderkey) AS ann_id, CASE WHEN o_orderstatus = 'P' THEN 'Cancellation of order' WHEN o_orderkey % 3 = 0 THEN 'Award & receipt of order' ELSE 'Outcome of meeting' END AS headline, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 330 MINUTE AS filed_at, o_orderkey % 5 = 0 AS targeted, o_orderkey % 5 = 0 OR (o_orderstatus <> 'P' AND o_orderkey % 3 = 0) AS is_order_like, o_orderstatus = 'P' AS is_amendment FROM orders")
def feed_normalised(spark, sf):
    """One row a filing, Indian time as UTC, the targeted mark kept."""
    s = ingest.silver(_once(spark, sf), F.lit("2030-01-01").cast("timestamp"))
    return s.select("ann_id", "headline", "filed_at", "targeted", "is_order_like", "is_amendment")


@query("SELECT count(*) AS fetched, count_if(o_orderkey % 5 = 0 OR (o_orderstatus <> 'P' AND o_orderkey % 3 = 0)) AS orders, count_if(o_orderstatus = 'P') AS amendments, count(*) AS late, max(CAST(o_orderdate AS TIMESTAMP)) - INTERVAL 330 MINUTE AS window_to FROM orders")
def run_metrics(spark, sf):
    """A12, K8."""
    return ingest.run_metrics(ingest.silver(_once(spark, sf), F.lit("2030-01-01").cast("timestamp")))


@query("SELECT 'bse' AS feed, false AS failed, count(*) AS fetched, count_if(o_orderkey % 5 = 0 OR (o_orderstatus <> 'P' AND o_orderkey % 3 = 0)) AS orders, count_if(o_orderstatus = 'P') AS amendments, count(*) AS late, count(*) AS stored FROM orders UNION ALL SELECT 'gone', true, NULL, NULL, NULL, NULL, NULL")
def venue_runs(spark, sf):
    """A run over two venues of which one cannot be read: counters observed in the write of the other, and a flag."""
    at = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    feeds = {"bse": lambda: _once(spark, sf), "gone": lambda: spark.read.parquet(f"{at}-landed")}
    return ingest.run(feeds, at, F.lit("2030-01-01").cast("timestamp"), number=0, tasks={"bse": lambda: _tasks(spark, sf)}).select("feed", "failed", "fetched", "orders", "amendments", "late", "stored")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """Tumbling windows over a batch; tests run the same over a stream."""
    return ingest.event_windows(base.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("SELECT DISTINCT event_id % 4000 AS ann_id FROM events")
def stream_dedupe_batch(spark, sf):
    """The batch side of exactly-once by key."""
    batch = base.table(spark, sf, "events").select((F.col("event_id") % 4000).alias("ann_id"))
    return ingest.append_new(batch, f"{shared_dir(spark)}/known-{uuid.uuid4().hex}", number=0).select("ann_id")


@query("SELECT c_custkey AS company_id, CASE WHEN c_custkey % 4 = 0 THEN 5e7::DOUBLE WHEN c_custkey % 4 = 1 THEN c_acctbal WHEN c_custkey % 4 = 2 THEN c_acctbal + 1 END AS q_revenue_inr FROM customer")
def fundamentals_precedence(spark, sf):
    """An override, a fresh source, a stale one, none."""
    c = base.companies(spark, sf)
    four = F.col("company_id") % 4
    who = c.select("company_id", F.concat(F.lit("s"), F.col("company_id").cast("string")).alias("symbol"), F.lit(None).cast("string").alias("bse_code"), F.lit(None).cast("string").alias("isin"))
    blank = [F.lit(None).cast("double").alias(n) for n in ("ttm_revenue_inr", "ebitda_margin", "market_cap_inr")] + [F.lit(None).cast("string").alias("latest_quarter")]
    over = c.filter(four == 0).select(F.concat(F.lit("S"), F.col("company_id").cast("string")).alias("key"), F.lit(5e7).alias("q_revenue_inr"), *blank)
    day = lambda d: F.lit(d).cast("timestamp").alias("fetched_at")
    first = c.filter(four == 1).select("company_id", F.col("balance").alias("q_revenue_inr"), *blank, day("2024-01-20")).unionByName(c.filter(four == 2).select("company_id", F.col("balance").alias("q_revenue_inr"), *blank, day("2023-01-01")))
    second = c.filter(four == 2).select("company_id", (F.col("balance") + 1).alias("q_revenue_inr"), *blank, day("2023-06-01"))
    return landed.fundamentals(who, over, first, second, now=F.lit("2024-02-01").cast("timestamp")).select("company_id", "q_revenue_inr")


QUERIES, ORACLES = Q, O
