"""Smaller rules as queries: merging two readings, freshness, identities, tolerant JSON, backward windows, guidance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.calendar import fiscal_year, stale
from ..operators import entity
from ..sources import landed
from . import base

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


_AB = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_totalprice * 1.5::DOUBLE ELSE o_totalprice END AS b"


@query(f"SELECT order_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN abs(a - b) > 0.02::DOUBLE * greatest(a, b) THEN b ELSE a END AS value, round(CASE WHEN a IS NULL OR b IS NULL THEN 0.6 WHEN abs(a - b) > 0.02::DOUBLE * greatest(a, b) THEN 0.6 * 0.85 ELSE 0.7 END::DOUBLE, 6) AS confidence FROM (SELECT o_orderkey AS order_id, {_AB} FROM orders)")
def reconciled_values(spark, sf):
    """Two readings of one figure."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    a = F.when(k % 5 != 0, v)
    b = F.when(k % 7 == 0, None).when(k % 2 == 0, v * 1.5).otherwise(v)
    r = base.table(spark, sf, "orders").select(k.alias("order_id"), scoring.reconcile(a, b, F.lit(0.6)).alias("r"))
    return r.select("order_id", "r.value", F.round("r.confidence", 6).alias("confidence"))


@query("SELECT user_id AS company_id FROM (SELECT user_id, max(ts) AS newest, bool_or(event_type = 'error') AS bad FROM events GROUP BY 1) WHERE newest < TIMESTAMP '2024-02-05' - INTERVAL 7 DAY OR bad")
def refresh_list(spark, sf):
    """Stale pages, and those that lack a market cap."""
    s = base.table(spark, sf, "events").groupBy(F.col("user_id").alias("company_id")).agg(F.max(F.col("ts").cast("timestamp")).alias("fetched_at"), F.when(~F.bool_or(F.col("event_type") == "error"), 1.0).alias("market_cap_inr"))
    return landed.to_refresh(s, F.lit("2024-02-05").cast("timestamp"), 7)


@query("SELECT c_custkey AS company_id, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE 'fresh' END AS sector FROM customer")
def sector_kept(spark, sf):
    """A label of the feed stays, an empty one is filled."""
    c = base.companies(spark, sf)
    known = F.when(F.col("company_id") % 4 == 0, F.col("sector")).when(F.col("company_id") % 4 == 1, "")
    return c.select("company_id", landed.sector(known, F.lit("fresh")).alias("sector"))


@query("SELECT c_custkey AS n, CASE c_custkey % 4 WHEN 0 THEN 'INE' || c_custkey WHEN 1 THEN 'NSE:S' || c_custkey WHEN 2 THEN 'BSE:' || c_custkey ELSE 'NAME:' || substr(sha1(c_name), 1, 12) END AS company_id FROM customer")
def minted_ids(spark, sf):
    """The id of a company from its best identifier."""
    c = base.companies(spark, sf)
    k, four = F.col("company_id").cast("string"), F.col("company_id") % 4
    return c.select(F.col("company_id").alias("n"), entity.mint(F.when(four == 0, F.concat(F.lit(" ine"), k)), F.when(four <= 1, F.concat(F.lit("s"), k)).otherwise(""), F.when(four <= 2, k), F.col("company_name")).alias("company_id"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_tolerant(spark, sf):
    """The first object in a chatty answer."""
    said = F.concat(F.lit("Sure, here it is: "), "props", F.lit(" Anything else?"))
    return base.table(spark, sf, "events").select("event_id", F.get_json_object(F.regexp_extract(said, r"(\{[\s\S]*\})", 1), "$.k").alias("k"))


@query("SELECT company_id, CAST(oldest - least(i * 7 + 7, 30)::INTEGER AS DATE) AS begins, CAST(oldest - (i * 7 + 1)::INTEGER AS DATE) AS ends FROM (SELECT o_custkey AS company_id, min(CAST(o_orderdate AS DATE)) AS oldest FROM orders GROUP BY 1), range(5) t(i)")
def backward_windows(spark, sf):
    """A month before the oldest filing, in weeks."""
    o = base.filings(spark, sf).groupBy("company_id").agg(F.min("filed_at").alias("oldest"))
    w = o.select("company_id", F.explode(landed.history_windows(F.col("oldest"), 30)).alias("w"))
    return w.select("company_id", F.col("w.from").alias("begins"), F.col("w.to").alias("ends"))


_M = "(low / 100.0::DOUBLE)"
_CURVE = "CASE WHEN {x} <= {lo} THEN 0.0 WHEN {x} >= {hi} THEN 1.0 ELSE ln({x} / {lo}) / ln({hi}::DOUBLE / {lo}::DOUBLE) END"


@query(
    f"SELECT order_id, round(100 * ({_CURVE.format(x=_M, lo=1.15, hi=2.0)} * 0.6::DOUBLE + {_CURVE.format(x='(pat / 10.0::DOUBLE)', lo=1.25, hi=3.0)} * 0.4::DOUBLE) / (0.6::DOUBLE + 0.4::DOUBLE) * CASE WHEN low / 100.0::DOUBLE > 8 THEN 0.3::DOUBLE ELSE 1 END * 1.0, 6) AS points, low > 800 AS implausible "
    "FROM (SELECT o_orderkey AS order_id, CAST(o_orderkey % 900 + 50 AS DOUBLE) AS low, CAST(o_orderkey % 40 + 5 AS DOUBLE) AS pat FROM orders)"
)
def guidance_points(spark, sf):
    """Revenue and profit guided for this year against the last."""
    f = base.filings(spark, sf, heavy=True)
    fy = fiscal_year(F.col("filed_at"))
    item = lambda metric, low: F.struct(fy.alias("fy_end"), F.lit(metric).alias("metric"), F.lit(metric).alias("label"), low.cast("double").alias("low_inr"), F.lit(None).cast("double").alias("growth_low"))
    items = F.array(item("revenue", F.col("order_id") % 900 + 50), item("pat", F.col("order_id") % 40 + 5))
    g = f.select("order_id", scoring.guidance_points(items, fy, fy - 1, F.lit(100.0), F.lit(0.0), F.lit(10.0), F.lit(None).cast("double")).alias("g"))
    return g.select("order_id", F.round("g.points", 6).alias("points"), "g.implausible")


QUERIES, ORACLES = Q, O
