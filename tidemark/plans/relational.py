"""Relational queries: filters, joins, aggregates, top-k, set operations, keys and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import calendar, scoring
from ..functions.calendar import days_apart
from ..operators import views
from ..sources import landed
from . import base

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with its SQL."""

    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


_F = f"WITH {base.FILINGS} "


def _light(spark: SparkSession, sf: str) -> DataFrame:
    """Filings with a score and tier that need no history, for view queries."""
    f = base.filings(spark, sf)
    score = F.col("firmness") * 100 - F.col("execution_months")
    return f.withColumn("score", score).withColumn("tier", F.when(score >= 75, "HIGH").when(score >= 60, "MEDIUM").when(score >= 40, "WATCH").otherwise("STORE")).withColumn("ratio_quarter", F.col("order_value_inr") / 2e10)


_L = f"WITH {base.FILINGS}, l AS (SELECT *, firmness * 100 - execution_months AS score, order_value_inr / 2e10 AS ratio_quarter, CASE WHEN firmness * 100 - execution_months >= 75 THEN 'HIGH' WHEN firmness * 100 - execution_months >= 60 THEN 'MEDIUM' WHEN firmness * 100 - execution_months >= 40 THEN 'WATCH' ELSE 'STORE' END AS tier FROM f) "


@query(_L + "SELECT order_id, company_id, c_name AS company_name, tier, filed_at FROM l JOIN customer ON c_custkey = company_id WHERE NOT is_amendment ORDER BY filed_at DESC, order_id LIMIT 5000")
def orders_view(spark, sf):
    """F1, J1, L1 with the page's own limit."""
    return views.orders_view(_light(spark, sf), base.companies(spark, sf)).select("order_id", "company_id", "company_name", "tier", "filed_at")


@query(_L + "SELECT order_id, c_name AS company_name, tier, exchange FROM l JOIN customer ON c_custkey = company_id WHERE NOT is_amendment AND CAST(filed_at AS DATE) >= DATE '1998-01-01' AND c_name ILIKE '%1%' AND tier = 'HIGH' AND exchange = 'NSE' AND score >= 80 AND ratio_quarter >= 0.5 ORDER BY filed_at DESC, order_id LIMIT 5000")
def orders_view_filtered(spark, sf):
    out = views.orders_view(_light(spark, sf), base.companies(spark, sf), name="1", tier="HIGH", exchange="NSE", since=F.lit("1998-01-01").cast("date"), min_score=80, min_ratio=0.5, has_value=True)
    return out.select("order_id", "company_name", "tier", "exchange")


@query(_L + "SELECT order_id, company_id, ratio_quarter FROM l ORDER BY ratio_quarter DESC NULLS LAST, order_id LIMIT 50 OFFSET 100")
def orders_view_paged(spark, sf):
    """L6."""
    return views.page(_light(spark, sf).select("order_id", "company_id", "ratio_quarter"), "ratio_quarter", descending=True, size=50, number=2, tie="order_id")


@query(_L + "SELECT count(*) AS orders, count(*) FILTER (tier = 'HIGH') AS high, count(*) FILTER (tier = 'MEDIUM') AS medium, count(*) FILTER (tier = 'WATCH') AS watch, count(*) FILTER (tier = 'STORE') AS store, count(order_value_inr) AS valued, count(DISTINCT company_id) AS companies FROM l")
def stats_tiers(spark, sf):
    """A2, A3, A9."""
    return views.tier_stats(_light(spark, sf))


@query("SELECT o_custkey AS company_id, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS v, arg_max(c_name, o_orderkey) AS company_name FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY v DESC, company_id LIMIT 15")
def top_companies(spark, sf):
    """A1, L2; sums in whole paise."""
    f = base.filings(spark, sf).join(base.companies(spark, sf), "company_id").withColumn("paise", F.bround(F.col("order_value_inr") / 1e3).cast("long"))
    return views.top_companies(f, "paise")


@query("SELECT o_custkey AS company_id FROM orders UNION SELECT user_id AS company_id FROM events")
def tracked_union(spark, sf):
    """U1, A4."""
    return views.tracked(base.filings(spark, sf), base.table(spark, sf, "events").select(F.col("user_id").alias("company_id")))


@query("SELECT o_orderkey AS order_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def new_ids_anti(spark, sf):
    """J8, J9, U3."""
    known = base.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id"))
    return views.new_only(base.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id")), known, "order_id")


@query("SELECT c_custkey AS company_id, c_name AS company_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT user_id FROM events)")
def semi_tracked(spark, sf):
    """J7, J10."""
    ids = views.tracked(base.filings(spark, sf), base.table(spark, sf, "events").select(F.col("user_id").alias("company_id")))
    return base.companies(spark, sf).join(ids, "company_id", "left_semi").select("company_id", "company_name")


@query(_F + "SELECT a.order_id, min(b.order_id) AS duplicate_of FROM f a JOIN f b ON a.company_id = b.company_id AND a.order_id <> b.order_id AND abs(a.order_value_inr - b.order_value_inr) <= greatest(1.0, 0.05::DOUBLE * a.order_value_inr) AND abs(epoch(a.filed_at) - epoch(b.filed_at)) <= 30 * 86400 GROUP BY 1")
def near_duplicate_orders(spark, sf):
    """J12, widened to 5 % and 30 days so that these tables have some."""
    return views.near_duplicates(base.filings(spark, sf), 0.05, 30)


@query("SELECT e.event_id, e.user_id, e.event_type FROM events e WHERE e.event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts DESC, event_id) = 1 ORDER BY CASE event_type WHEN 'click' THEN 7 ELSE 7 END, ts DESC, event_id LIMIT 200")
def candidates_ranked(spark, sf):
    """A third counts as read already."""
    e = base.table(spark, sf, "events").select(F.col("event_id").alias("ann_id"), F.col("user_id").alias("company_id"), F.col("event_type").alias("kind"), F.col("ts").alias("filed_at"))
    out = views.candidates(e, e.filter("ann_id % 3 = 0").select("ann_id"), 200)
    return out.select(F.col("ann_id").alias("event_id"), F.col("company_id").alias("user_id"), F.col("kind").alias("event_type"))


@query("SELECT o_orderkey AS order_id, list_filter([CASE WHEN v < 0.98::DOUBLE * o THEN 'smaller than the order' END, CASE WHEN v > 40 * r THEN 'over 40 years of revenue' END, CASE WHEN t AND v < 0.02::DOUBLE * r THEN 'under 2 % of revenue' END], lambda x: x IS NOT NULL) AS flags FROM (SELECT o_orderkey, o_totalprice AS v, o_orderkey % 7 * 50000.0::DOUBLE AS o, o_orderkey % 11 * 20000.0::DOUBLE AS r, o_orderkey % 2 = 0 AS t FROM orders)")
def plausibility_flags(spark, sf):
    """F13."""
    o = base.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("order_id"), views.plausibility(F.col("o_totalprice"), k % 2 == 0, k % 11 * 20000.0, k % 7 * 50000.0).alias("flags"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 40")
def budget_rank(spark, sf):
    """L10."""
    return views.budget(base.table(spark, sf, "events"), "event_type", ["ts", "event_id"], 40).select("event_id", "event_type")


@query("SELECT user_id, least(greatest(m - INTERVAL 10 MINUTE, t - INTERVAL 96 HOUR), t - INTERVAL 70 MINUTE) AS start FROM (SELECT user_id, max(ts) AS m, TIMESTAMP '2024-02-01' AS t FROM events GROUP BY 1)")
def catchup_window(spark, sf):
    """R2, A5."""
    s = SETTINGS
    runs = base.table(spark, sf, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("m"))
    return runs.select("user_id", views.catch_up_start(F.col("m"), F.lit("2024-02-01").cast("timestamp"), s.overlap_minutes, s.catchup_hours, s.lookback_minutes).alias("start"))


@query("SELECT l_orderkey, l_linenumber, date_diff('second', CAST(o_orderdate AS TIMESTAMP), CAST(l_shipdate AS TIMESTAMP)) / 3600 > 48 * 24 AS stale FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def lateness_stale(spark, sf):
    """Seen long after filing (days stand for hours in these tables)."""
    li, o = base.table(spark, sf, "lineitem"), base.table(spark, sf, "orders")
    late = calendar.stale(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp"), 48)
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", late.alias("stale"))


@query("SELECT o_orderkey AS order_id, sha1(CASE WHEN o_orderkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END || '|' || CAST(o_orderkey AS VARCHAR)) AS ann_id FROM orders")
def hash_ids(spark, sf):
    """X6."""
    return landed.keyed(base.filings(spark, sf).withColumn("native_id", F.col("order_id").cast("string"))).select("order_id", "ann_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_path(spark, sf):
    """X3."""
    e = base.table(spark, sf, "events").select("event_id", scoring.read_back("props", "k").cast("long").alias("k"))
    return e.filter("k > 50")


@query("SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || CAST(user_id AS VARCHAR) || '}' AS body, substr('{\"type\":\"' || event_type || '\"}', 1, 12) AS cut FROM events")
def json_build(spark, sf):
    """X1, X2, X9."""
    e = base.table(spark, sf, "events")
    return e.select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("body"), F.substring(F.to_json(F.struct(F.col("event_type").alias("type"))), 1, 12).alias("cut"))


@query("SELECT c_mktsegment AS sector, CASE WHEN GROUPING(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS priority, count(*) AS n, count(DISTINCT o_custkey) AS companies FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY GROUPING SETS ((c_mktsegment, o_orderpriority), (c_mktsegment))")
def sector_report(spark, sf):
    """An extension of A13: kinds by sector with subtotals."""
    j = base.table(spark, sf, "orders").join(base.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupingSets([["c_mktsegment", "o_orderpriority"], ["c_mktsegment"]], "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("companies"), F.grouping("o_orderpriority").alias("g"))
    return g.select(F.col("c_mktsegment").alias("sector"), F.when(F.col("g") == 1, "all").otherwise(F.col("o_orderpriority")).alias("priority"), "n", "companies")


@query("SELECT DISTINCT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def nations_both(spark, sf):
    """U4 as available in Spark."""
    s, c = base.table(spark, sf, "supplier"), base.table(spark, sf, "customer")
    return s.select(F.col("s_nationkey").alias("nation")).intersect(c.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")))


@query("SELECT c_custkey AS company_id, count(o_orderkey) AS n, coalesce(count_if(o_orderstatus = 'P'), 0) AS amendments, max(CAST(o_orderdate AS TIMESTAMP)) AS newest FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1")
def wins_in_period(spark, sf):
    """Orders won in the period, pre-aggregated before the join."""
    w = views.wins(base.filings(spark, sf), F.lit("1999-01-01").cast("date"))
    return base.companies(spark, sf).select("company_id").join(w, "company_id", "left").select("company_id", F.coalesce("wins", F.lit(0)).alias("n"), F.coalesce("amendments", F.lit(0)).alias("amendments"), "newest")


@query("SELECT order_key, max(v) AS v, arg_max(status, ver) AS status FROM (SELECT o_orderkey AS order_key, 0 AS ver, o_totalprice AS v, o_orderstatus AS status FROM orders UNION ALL SELECT l_orderkey, 1, NULL, 'S' FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 = 0) GROUP BY 1")
def upsert_orders(spark, sf):
    """A column that the new rows do not carry keeps its value."""
    old = base.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("ver"))
    new = base.table(spark, sf, "lineitem").filter("l_linenumber = 1 AND l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("order_key"), F.lit("S").alias("status"), F.lit(1).alias("ver"))
    return views.upsert(old, new, "order_key", "ver").drop("ver")


@query("SELECT l_orderkey AS ann_id, l_linenumber AS k FROM lineitem WHERE l_orderkey % 2 = 1 UNION ALL SELECT l_orderkey, 10 + l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) <= 2")
def replace_filing(spark, sf):
    """K2 with at most two rows a filing."""
    li = base.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ann_id"), F.col("l_linenumber").alias("k"))
    new = li.filter("ann_id % 2 = 0").select("ann_id", (F.col("k") + 10).alias("k"))
    return views.replace_by_filing(li, new, "ann_id", [F.desc("k")], 2)


@query("SELECT a.order_id AS order_id, abs(floor((epoch(a.filed_at) - epoch(a.prev)) / 86400))::BIGINT AS gap FROM (WITH " + base.FILINGS + " SELECT *, lag(filed_at) OVER (PARTITION BY company_id ORDER BY filed_at, order_id) AS prev FROM f) a WHERE prev IS NOT NULL")
def days_between(spark, sf):
    """D15, W13."""
    f = base.filings(spark, sf)
    prev = F.lag("filed_at").over(W.partitionBy("company_id").orderBy("filed_at", "order_id"))
    return f.withColumn("prev", prev).filter("prev IS NOT NULL").select("order_id", days_apart(F.col("filed_at"), F.col("prev")).cast("long").alias("gap"))


QUERIES, ORACLES = Q, O
