"""Queries over what is stored: rescore, recheck, resummarise, backfill, retries, and figures of companies from landed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import replay
from ..sources import landed
from . import base, filed, scored

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


_FROM, _TO = filed.ROUNDED.index(" r AS (SELECT f.order_id"), filed.ROUNDED.index(" i AS (SELECT f.*")
#: The score by figures of the company, and firmness by kind for every third order.
_RESCORED = (filed.ROUNDED[:_FROM] + " r AS (SELECT order_id, (company_id % 50 + 1) * 2e9::DOUBLE AS qr, (company_id % 50 + 1) * 9e9::DOUBLE AS ttm FROM f),\n" + filed.ROUNDED[_TO:]).replace("i AS (SELECT f.*", "i AS (SELECT f.* REPLACE (CASE WHEN f.order_id % 3 = 0 THEN 0.6::DOUBLE ELSE f.firmness END AS firmness)")


@query(_RESCORED + "SELECT order_id, round(s, 1) AS score, tier FROM z")
def rescored_orders(spark, sf):
    """Stored orders scored again by their companies' figures; every third has no breakdown."""
    k = F.col("company_id")
    stored = F.to_json(F.struct(F.struct(F.struct("firmness").alias("firmness")).alias("components")))
    orders = base.filings(spark, sf, heavy=True).withColumn("order_value_inr", F.round("order_value_inr"))
    orders = orders.withColumns({"breakdown": F.when(F.col("order_id") % 3 != 0, stored), "order_type": F.lit("loi"), "is_related_party": F.col("order_id") % 17 == 0, "extraction_conf": (F.col("order_id") % 10) / 10})
    seen = orders.select(F.col("order_id").alias("ann_id"), F.timestamp_add("HOUR", (F.col("order_id") % 60).cast("int"), F.col("filed_at")).alias("seen_at"))
    c = base.companies(spark, sf)
    own = c.select("company_id", (k % 5 == 0).alias("is_sme"), F.when(k % 2 == 0, k * 1e8).alias("market_cap_inr"))
    figures = c.select("company_id", ((k % 50 + 1) * 2e9).alias("q_revenue_inr"), ((k % 50 + 1) * 9e9).alias("ttm_revenue_inr"), F.when(F.col("balance") > 0, F.col("balance") / 40000).alias("ebitda_margin"))
    return replay.rescore(orders, seen, own, figures).select("order_id", F.round("score", 1).alias("score"), "tier")


@query(filed.ROUNDED + f"SELECT order_id, array_to_string(list_filter({filed.REASONS}, lambda x: x IS NOT NULL), '; ') AS reasons FROM z")
def score_reasons(spark, sf):
    """Why each order stands where it does."""
    s = scoring.with_breakdown(scored.scored(spark, sf))
    return s.select("order_id", F.array_join(F.from_json("breakdown", "reasons array<string>")["reasons"], "; ").alias("reasons"))


def _stored(spark, sf) -> tuple[DataFrame, DataFrame]:
    k = F.col("order_id")
    f = filed._filings(spark, sf).withColumns({"ann_id": k, "is_order_like": k % 4 <= 2, "pdf_url": F.when(k % 5 == 0, F.lit("filing.pdf"))})
    held = f.filter((k % 2 == 0) & (k % 3 != 0)).select("order_id", F.lit(1e7).alias("order_value_inr"), F.lit(None).cast("double").alias("execution_months"))
    return f.drop("order_id"), held


@query("SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 = 2 THEN CASE WHEN o_orderkey % 3 <> 0 THEN 'dropped' ELSE 'none' END WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 THEN 'refreshed' WHEN o_orderkey % 5 = 0 THEN 'needs_text' ELSE 'created' END AS outcome FROM orders WHERE o_orderkey % 4 <= 2")
def recheck_outcomes(spark, sf):
    """Stored filings read again by the rules of today."""
    filings, held = _stored(spark, sf)
    return replay.recheck(filings, held).select(F.col("ann_id").alias("order_id"), "outcome")


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 7 = 0 THEN 'kept' WHEN o_orderkey % 4 = 2 THEN 'Company declared L1 bidder in tender (₹' || (o_orderkey % 900 + 100) || ' Cr).' ELSE '₹' || (o_orderkey % 900 + 100) || ' Cr order from Jal Nigam' || CASE WHEN o_orderkey % 4 = 0 THEN ' for design and supply of water pumps' ELSE '' END || ', over '
 || CASE WHEN m = 1 THEN '1 month' WHEN m = 12 THEN '1 year' WHEN m % 12 = 0 THEN m // 12 || ' years' ELSE m || ' months' END || '.' END AS summary FROM (SELECT o_orderkey, o_orderkey % 36 + 1 AS m FROM orders)""")
def resummarised_orders(spark, sf):
    """Descriptions of all orders rebuilt from stored texts: with the work they name, by the filing's own title, or without either; a model's own stays."""
    k = F.col("order_id")
    f = filed._filings(spark, sf)
    orders = f.select("order_id", F.lit("Jal Nigam").alias("customer"), F.lit("work order").alias("order_type"), ((k % 900 + 100) * 1e7).alias("order_value_inr"), (k % 36 + 1).cast("double").alias("execution_months"), F.lit(None).cast("string").alias("scope"), F.lit("kept").alias("summary"), F.when(k % 7 == 0, "rules+llm").otherwise("rules").alias("extraction_method"))
    return replay.resummarise(orders, f.withColumn("ann_id", k)).select("order_id", "summary")


@query("SELECT c_custkey AS company_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'P') OR count(*) FILTER (o_orderstatus <> 'P') >= 12)")
def work_left(spark, sf):
    """What a resumable run still has to do: not done, and not failed too often."""
    tries = base.table(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), (F.col("o_orderstatus") == "P").alias("ok"))
    return replay.work_left(base.companies(spark, sf), tries, "company_id", 12).select("company_id")


@query("SELECT CAST(ceil((epoch(TIMESTAMP '1998-01-01 06:00:00') - epoch(CAST(o_orderdate AS TIMESTAMP))) / 86400) AS INTEGER) AS day, count(*) AS announcements, count(*) FILTER (o_orderkey % 3 = 0) AS order_like FROM orders WHERE CAST(o_orderdate AS TIMESTAMP) <= TIMESTAMP '1998-01-01 06:00:00' - INTERVAL 1 MICROSECOND AND CAST(o_orderdate AS TIMESTAMP) >= TIMESTAMP '1998-01-01 06:00:00' - INTERVAL 2000 DAY GROUP BY 1")
def backfill_days(spark, sf):
    """A backfill of 2,000 days as one batch, counted day by day."""
    f = base.filings(spark, sf).withColumn("is_order_like", F.col("order_id") % 3 == 0)
    return replay.day_totals(replay.by_days(f, F.lit("1998-01-01 06:00:00").cast("timestamp"), 2000)).select("day", "announcements", "order_like")


@query("SELECT o_orderkey AS order_id FROM orders WHERE o_custkey % 2 = 0")
def tracked_snapshot(spark, sf):
    """Filings of the companies that were tracked when the run began."""
    snapshot = replay.frozen(base.companies(spark, sf).filter("company_id % 2 = 0"))
    return replay.of_tracked(base.filings(spark, sf), snapshot).select("order_id")


@query("SELECT DISTINCT c_name AS company_name, 'doc-' || o_orderkey % 1000 AS pdf_url FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0")
def order_documents(spark, sf):
    """The distinct attachments of filings that gave an order."""
    k = F.col("order_id")
    f = base.filings(spark, sf).join(base.companies(spark, sf), "company_id")
    docs = f.select(k.alias("ann_id"), "company_name", F.when(k % 3 != 0, F.concat(F.lit("doc-"), (k % 1000).cast("string"))).alias("pdf_url"))
    return replay.order_documents(f, docs)


def _quarters(spark, sf) -> DataFrame:
    o = base.table(spark, sf, "orders")
    q = o.groupBy(F.col("o_custkey").alias("company_id"), F.trunc("o_orderdate", "quarter").alias("quarter")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("v"))
    return q.withColumn("position", F.row_number().over(W.partitionBy("company_id").orderBy(F.desc("quarter"))))


_QUARTERS = "q AS (SELECT o_custkey AS company_id, date_trunc('quarter', o_orderdate)::DATE AS quarter, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS v FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY quarter DESC) AS k FROM q)"


@query(f"""WITH {_QUARTERS}, m AS (SELECT company_id, max(CASE WHEN k = 1 THEN strftime(quarter, '%Y-%m-%d') END) AS latest_quarter, max(v) FILTER (k = 1) * 1e5::DOUBLE AS q1, sum(v) FILTER (k <= 4) * 1e5::DOUBLE AS t1, sum(v) FILTER (k BETWEEN 5 AND 8) * 1e5::DOUBLE AS t2, max(v) FILTER (k = 5) * 1e5::DOUBLE AS ago, max(v // 2) FILTER (k = 1) * 1e5::DOUBLE AS ex, max(v // 4) FILTER (k = 1) * 1e5::DOUBLE AS pat, count(*) AS n FROM r GROUP BY 1)
 SELECT company_id, latest_quarter, q1 AS q_revenue_inr, CASE WHEN n >= 4 THEN t1 END AS ttm_revenue_inr, CASE WHEN n >= 8 THEN t2 END AS prev_ttm_revenue_inr, round(1 - ex / q1, 6) AS ebitda_margin, round(pat / q1, 6) AS net_margin, round(q1 / ago - 1, 6) AS q_revenue_yoy, CASE WHEN n >= 4 THEN 0.9::DOUBLE ELSE 0.65 END AS confidence FROM m""")
def quarterly_results(spark, sf):
    """Landed results in lakhs under two names of revenue, as figures in rupees, sums and margins."""
    v, even = F.col("v"), F.col("company_id") % 2 == 0
    raw = _quarters(spark, sf).select("company_id", "position", F.col("quarter").cast("string").alias("to_date"), F.when(even, F.format_number("v", 0)).alias("income"), F.when(~even, v.cast("string")).otherwise("-").alias("revenue"), F.floor(v / 2).cast("string").alias("exp"), F.floor(v / 4).cast("string").alias("pat"))
    m = landed.metrics(landed.results(raw), F.lit("venue"))
    return m.select("company_id", "latest_quarter", "q_revenue_inr", "ttm_revenue_inr", "prev_ttm_revenue_inr", *[F.round(c, 6).alias(c) for c in ("ebitda_margin", "net_margin", "q_revenue_yoy")], "confidence")


@query(f"""WITH {_QUARTERS}, m AS (SELECT company_id, CASE WHEN company_id % 4 = 0 THEN 1 ELSE 2 END AS w, max(v) FILTER (k = 1) AS q1, sum(v) FILTER (k <= 4) AS t1, max(v // 3) FILTER (k = 1) AS e, count(*) AS n FROM r GROUP BY 1)
 SELECT company_id, (q1 * w)::DOUBLE AS q_revenue_inr, CASE WHEN n >= 4 THEN (t1 * w)::DOUBLE END AS ttm_revenue_inr, CASE WHEN company_id % 4 <> 0 THEN round(e::DOUBLE / (q1 * w)::DOUBLE, 6) END AS ebitda_margin, 'vendor:' || CASE WHEN company_id % 4 = 0 THEN 'S' || company_id || '.NS' ELSE 'B' || company_id || '.BO' END AS source, 0.7::DOUBLE AS confidence FROM m""")
def vendor_metrics(spark, sf):
    """The same from a second vendor's statements: a fourth of the companies have revenue under their symbol."""
    k = F.col("company_id")
    row = lambda ticker, item, amount: F.struct(ticker.alias("ticker"), F.lit(item).alias("item"), amount.cast("double").alias("amount"))
    ns, bo = F.concat(F.lit("S"), k.cast("string"), F.lit(".NS")), F.concat(F.lit("B"), k.cast("string"), F.lit(".BO"))
    rows = F.array(row(ns, "Total Revenue", F.when(k % 4 == 0, F.col("v"))), row(bo, "Operating Revenue", F.col("v") * 2), row(bo, "Revenue", F.lit(1)), row(bo, "EBITDA", F.floor(F.col("v") / 3)))
    statements = _quarters(spark, sf).select("company_id", "quarter", F.inline(rows)).drop("company_id")
    c = base.companies(spark, sf).select("company_id", F.concat(F.lit("S"), k.cast("string")).alias("symbol"), F.concat(F.lit("B"), k.cast("string")).alias("bse_code"))
    return landed.vendor(statements, c).select("company_id", "q_revenue_inr", "ttm_revenue_inr", F.round("ebitda_margin", 6).alias("ebitda_margin"), "source", "confidence")


@query("SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 1e7::DOUBLE ELSE 9e7::DOUBLE END AS market_cap_inr, 2025 AS last_fy, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN (c_custkey + 100) * 1e7::DOUBLE ELSE 77e7::DOUBLE END AS last_fy_revenue_inr, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'consolidated' ELSE 'standalone' END AS revenue_basis FROM customer")
def company_pages(spark, sf):
    """Of two pages a company the first that has what is asked."""
    k = F.col("company_id")
    table = lambda kind, sales: F.concat(F.lit(f'<p>{kind} figures</p><section id="profit-loss"><table><tr><th></th><th>Mar 2024</th><th>Mar 2025</th></tr><tr><td>Sales</td><td>10</td><td>'), sales.cast("string"), F.lit("</td></tr><tr><td>Other Income</td><td>1</td><td>2</td></tr><tr><td>Net Profit</td><td>3</td><td>4</td></tr></table></section>"))
    cap = lambda x: F.concat(F.lit("<li>Market Cap "), x.cast("string"), F.lit(" Cr</li>"))
    c = base.companies(spark, sf)
    first = c.filter(k % 3 != 0).select("company_id", F.concat(cap(k), F.when(k % 2 == 0, table("Consolidated", k + 100)).otherwise("")).alias("page"))
    return landed.company_pages(first, c.select("company_id", F.concat(cap(F.lit(9)), table("Standalone", F.lit(77))).alias("page")))


QUERIES, ORACLES = Q, O
