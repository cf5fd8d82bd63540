"""Whole filings: extraction end to end, and the pages built on scored orders and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filing, orderbook, scoring
from ..operators import pages, sequences
from ..shared import cut
from ..streaming import ingest
from . import base, scored, series

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


def _filings(spark, sf):
    """Rendered filings: an order, one to be cancelled, a bidder's notice, a board meeting."""
    f = base.filings(spark, sf, heavy=True).join(base.companies(spark, sf), "company_id")
    four = F.col("order_id") % 4
    crore = (F.col("order_id") % 900 + 100).cast("string")
    head = F.when(four == 0, "Receipt of work order").when(four == 1, "Cancellation of order").when(four == 2, "Company declared L1 bidder in tender").otherwise("Board Meeting Intimation")
    body = F.when(four == 0, F.concat(F.lit("We have received a work order from Jal Nigam worth Rs "), crore, F.lit(" crore for design and supply of water pumps, to be completed within "), (F.col("order_id") % 36 + 1).cast("string"), F.lit(" months."))).when(four == 1, F.concat(F.lit("The purchase order of Rs "), crore, F.lit(" crore stands cancelled."))).when(four == 2, F.lit("The company has emerged as lowest bidder for a contract.")).otherwise(F.lit("A meeting of the board is called."))
    return f.select("order_id", "company_id", "filed_at", F.lit("Our Own Pumps Limited").alias("company_name"), head.alias("headline"), body.alias("body"), F.lit(None).cast("string").alias("attachment"), F.lit(None).cast("string").alias("subcategory"))


@query("SELECT o_orderkey AS order_id, o_orderkey % 4 <= 1 AS is_order, CASE WHEN o_orderkey % 4 <= 1 THEN CAST((o_orderkey % 900 + 100) * 1e7 AS BIGINT) END AS value, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 36 + 1 AS DOUBLE) END AS months, CASE WHEN o_orderkey % 4 = 0 THEN 'Jal Nigam' END AS customer, CASE o_orderkey % 4 WHEN 0 THEN 'government' WHEN 1 THEN 'unknown' END AS customer_type, CASE WHEN o_orderkey % 4 <= 1 THEN o_orderkey % 4 = 1 END AS is_amendment, CASE o_orderkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0 END AS firmness, CASE WHEN o_orderkey % 4 = 0 THEN 'design and supply of water pumps' END AS scope FROM orders")
def extract_filings(spark, sf):
    """T15 end to end: F2, F3, F5-F7, M10, D4, T5-T11, Y3."""
    e = filing.extract(_filings(spark, sf))
    return e.select("order_id", "is_order", F.bround("order_value_inr").cast("long").alias("value"), F.col("execution_months").alias("months"), "customer", "customer_type", "is_amendment", "firmness", "scope")


@query("SELECT o_orderkey AS order_id, CASE WHEN k THEN c * 10000000 END AS value, CASE WHEN k THEN make_date(year(o_orderdate), 1 + 3 * (quarter(o_orderdate) - 1), 1) - 1 END AS as_of, CASE WHEN NOT k THEN NULL WHEN o_orderkey % 2 = 0 THEN 'total' ELSE 'segment' END AS scope FROM (SELECT *, CAST(o_totalprice AS BIGINT) AS c, CAST(o_totalprice AS BIGINT) BETWEEN 1 AND 1999999 AS k FROM orders)")
def rendered_order_book(spark, sf):
    """A book of every order's size; one past what a book can be is not read."""
    f = base.filings(spark, sf, heavy=True).withColumn("crore", F.bround(F.col("order_value_inr") / 1e5).cast("long"))
    label = F.when(F.col("order_id") % 2 == 0, "unexecuted order book").otherwise("railway order book")
    said = F.concat(F.lit("Results were good. We ended the quarter with a "), label, F.lit(" of Rs. "), F.col("crore").cast("string"), F.lit(" crore. Order inflow was Rs. 12 crore."))
    b = f.select("order_id", F.get(orderbook.find_order_books(said, F.to_date("filed_at"), F.lit("results")), 0).alias("b"))
    return b.select("order_id", F.bround("b.value_inr").cast("long").alias("value"), "b.as_of", "b.scope")


@query(series._P + ", g AS (SELECT company_id, arg_max(order_book_inr, as_of) AS order_book_inr, max(as_of) AS as_of, count(*) AS n FROM b GROUP BY 1), w AS (SELECT company_id, count(*) AS wins FROM f WHERE CAST(filed_at AS DATE) >= DATE '2000-01-01' - 366 GROUP BY 1) SELECT g.company_id, order_book_inr, as_of, least(n, 12) AS points, wins FROM g LEFT JOIN w USING (company_id)")
def orderbook_page(spark, sf):
    """A7, J5, J11, J16, W9, W11."""
    best = sequences.best_per_quarter(series._points(spark, sf))
    revenue = base.companies(spark, sf).select("company_id", F.lit(1e9).alias("annual_revenue_inr"))
    rows = pages.order_books(best, base.companies(spark, sf), revenue, base.filings(spark, sf), as_of=F.lit("2000-01-01").cast("date"))
    return rows.select("company_id", "order_book_inr", "as_of", F.size("history").cast("long").alias("points"), "wins")


@query(series.ORACLES["growth_period"].replace("SELECT g.company_id, round", "SELECT * FROM (SELECT g.company_id, round").replace("WHERE from_value <> 0 GROUP BY ALL", "WHERE from_value <> 0 GROUP BY ALL) QUALIFY row_number() OVER (ORDER BY pct DESC, company_id) <= 12 AND NOT suspect").replace("SELECT * FROM (SELECT g.company_id", "SELECT company_id, pct, row_number() OVER (ORDER BY pct DESC, company_id) AS rank FROM (SELECT g.company_id").replace("GROUP BY ALL) QUALIFY", "GROUP BY ALL) WHERE NOT suspect QUALIFY").replace(" AND NOT suspect", ""))
def top_gainers(spark, sf):
    """W12, L9."""
    best = sequences.best_per_quarter(series._points(spark, sf)).select("company_id", "as_of", "order_book_inr")
    g = sequences.growth(best, 366).withColumn("pct", F.round("pct", 6))
    return pages.gainers(g).select("company_id", "pct", F.col("rank").cast("long").alias("rank"))


@query(scored._SCORED + "SELECT order_id, tier FROM z WHERE tier = 'WATCH' ORDER BY round(round(s, 2), 1) DESC, order_id LIMIT 25")
def watch_digest(spark, sf):
    """K6, L8."""
    s = scored.scored(spark, sf, exact=True).withColumn("score", scoring.half_up(F.col("score"), 1))
    return pages.digest(s).select("order_id", "tier")


#: The score as it is stored, rounded before the tier is taken of it.
ROUNDED = scored._SCORED.replace("CASE WHEN is_amendment THEN 25 ELSE 100 END) AS s FROM l)", "CASE WHEN is_amendment THEN 25 ELSE 100 END) AS u FROM l), mm AS (SELECT *, round_even(u, 2) AS s FROM m)").replace("END AS t FROM m)", "END AS t FROM mm)")
#: Why an order stands where it does, as a list with gaps.
REASONS = """[CASE WHEN gate < 1 THEN 'size of the order counts the rest at ' || format('{:,.0f}', gate * 100) || '%' END, CASE WHEN conf < 0.6 THEN 'read with little confidence (' || format('{:,.2f}', conf) || ')' END, CASE WHEN ttm IS NULL THEN 'revenue unknown, so the score stops at its cap' END,
 CASE WHEN is_amendment THEN 'changes or ends an order and is no new one' END, CASE WHEN implausible THEN 'hard to believe: the order is ' || format('{:,.0f}', rq) || ' times what the last quarter brought' END, CASE WHEN order_value_inr < 1e7 THEN 'worth less than the least value that is told' END,
 CASE WHEN s >= 75 AND t = 'MEDIUM' THEN 'not firm, so MEDIUM at most' END, CASE WHEN tier <> t THEN 'raised: the order is ' || format('{:,.0f}', rq * 100) || '% of what the last quarter brought' END]"""
_ALERTS = (
    ROUNDED
    + """, a AS (SELECT z.*, c_name FROM z JOIN customer ON c_custkey = company_id WHERE tier IN ('HIGH', 'MEDIUM') AND NOT EXISTS (SELECT 1 FROM f b WHERE b.company_id = z.company_id AND b.order_id < z.order_id
   AND abs(z.order_value_inr - b.order_value_inr) <= greatest(1.0, 0.005::DOUBLE * z.order_value_inr) AND abs(epoch(z.filed_at) - epoch(b.filed_at)) <= 3 * 86400)),
 p AS (SELECT order_id, row_number() OVER (PARTITION BY order_id ORDER BY -round(share * w, 2), label, share) AS k, repeat('#', CAST(round_even(greatest(0.0, least(1.0, share)) * 10, 0) AS INTEGER)) || repeat('.', 10 - CAST(round_even(greatest(0.0, least(1.0, share)) * 10, 0) AS INTEGER)) || ' ' || label AS line
  FROM (SELECT order_id, unnest([{'label': 'size by year', 'w': 40.0, 'share': f_annualised}, {'label': 'size by quarter', 'w': 20.0, 'share': f_quarterly}, {'label': 'firmness', 'w': 15.0, 'share': f_firmness}, {'label': 'margin', 'w': 10.0, 'share': f_margin}, {'label': 'novelty', 'w': 10.0, 'share': f_novelty}, {'label': 'capacity', 'w': 5.0, 'share': f_capacity}], recursive := true) FROM a)),
 t AS (SELECT order_id, string_agg(line, chr(10) ORDER BY k) AS top FROM p WHERE k <= 3 GROUP BY 1)
 SELECT order_id, '<b>' || replace(replace(replace(c_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</b> ' || tier || ' ' || format('{:,.1f}', s) || chr(10)
  || CASE WHEN order_value_inr >= 1e7 THEN 'Rs ' || format('{:,.2f}', order_value_inr / 1e7) || ' Cr' WHEN order_value_inr >= 1e5 THEN 'Rs ' || format('{:,.2f}', order_value_inr / 1e5) || ' L' ELSE 'Rs ' || format('{:,.0f}', order_value_inr) END || ' over ' || CASE WHEN execution_months IN (24, 36) THEN CAST(execution_months / 12 AS INTEGER) || ' years' ELSE CAST(execution_months AS INTEGER) || ' months' END
  || CASE WHEN rq IS NOT NULL THEN chr(10) || format('{:,.0f}', rq * 100) || '% of a quarter' ELSE '' END || chr(10) || top || coalesce((SELECT chr(10) || string_agg('• ' || replace(replace(replace(r, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10) ORDER BY k) FROM (SELECT unnest(list_filter(""" + REASONS + """, lambda x: x IS NOT NULL)[1:3]) AS r, generate_subscripts(list_filter(""" + REASONS + """, lambda x: x IS NOT NULL)[1:3], 1) AS k)), '') AS message FROM a JOIN t USING (order_id)"""
)


@query(_ALERTS)
def alert_messages(spark, sf):
    """A message for every order to alert of: tier HIGH or MEDIUM, and no twin of one of a smaller id."""
    # scored once, then looked at twice: for twins and for the messages
    return pages.message(ingest.to_alert(cut(scored.scored(spark, sf), "scored")))


@query(_ALERTS)
def alert_messages_all(spark, sf):
    """The same as `alert_messages`, under the name it had while that was a part."""
    return alert_messages(spark, sf)


QUERIES, ORACLES = Q, O
