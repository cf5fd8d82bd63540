"""Sequence queries: quarters, groups, order-book series, growth, collapse, alarms, as-of picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import fiscal_year, fiscal_year_end_before, quarter_end_before, quarter_label
from ..operators import sequences, views
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


_F = f"WITH RECURSIVE {base.FILINGS}"


def _quarters(spark, sf) -> DataFrame:
    f = base.filings(spark, sf)
    return f.groupBy("company_id", quarter_label(F.col("filed_at")).alias("quarter")).agg(F.sum(F.bround(F.col("order_value_inr") / 1e3).cast("long")).alias("revenue"))


@query("WITH q AS (SELECT o_custkey AS company_id, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS v FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY quarter DESC) AS k FROM q) SELECT company_id, max(v) FILTER (k = 1) AS latest, sum(v) FILTER (k <= 4)::BIGINT AS ttm, sum(v) FILTER (k BETWEEN 5 AND 8)::BIGINT AS previous_ttm, max(v) FILTER (k = 5) AS year_ago, count(*) AS n, max(v) FILTER (k = 1) - max(v) FILTER (k = 5) AS yoy_latest FROM r WHERE k <= 8 GROUP BY 1")
def ttm_yoy(spark, sf):
    """S10, A8."""
    return sequences.quarterly_metrics(_quarters(spark, sf))


@query("SELECT o_orderkey AS order_id, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS fy, CAST(date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY AS DATE) AS quarter_end, make_date(CASE WHEN strftime(o_orderdate, '%m%d') > '0331' THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END, 3, 31) AS fy_end, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter FROM orders")
def fiscal_calendar(spark, sf):
    """D7, D9, D10, D13."""
    f = base.filings(spark, sf)
    d = F.to_date("filed_at")
    return f.select("order_id", fiscal_year(d).alias("fy"), quarter_end_before(d).alias("quarter_end"), fiscal_year_end_before(d).alias("fy_end"), quarter_label(d).alias("quarter"))


@query(_F + """, s AS (SELECT company_id, order_id, date_diff('day', DATE '1970-01-01', CAST(filed_at AS DATE)) AS d, row_number() OVER (PARTITION BY company_id ORDER BY filed_at, order_id) AS k FROM f),
 r AS (SELECT company_id, order_id, d, k, d AS anchor FROM s WHERE k = 1 UNION ALL SELECT s.company_id, s.order_id, s.d, s.k, CASE WHEN s.d - r.anchor > 31 THEN s.d ELSE r.anchor END FROM r JOIN s ON s.company_id = r.company_id AND s.k = r.k + 1)
 SELECT company_id, anchor, count(*) AS n, min(order_id) AS first_order FROM r GROUP BY 1, 2""")
def greedy_groups_31d(spark, sf):
    """W4."""
    f = base.filings(spark, sf)
    g = sequences.greedy_groups(f, ["company_id"], F.unix_date(F.to_date("filed_at")), 31, ["order_id"])
    return g.groupBy("company_id", "anchor").agg(F.count("*").alias("n"), F.min("order_id").alias("first_order"))


def _points(spark, sf) -> DataFrame:
    """Order-book statements from orders: the kind from the priority, the date basis from the key."""
    f = base.filings(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, ("update", "presentation", "press_release", "transcript", "annual"))), F.pmod("order_id", F.lit(5)).cast("int") + 1)
    return f.select("company_id", F.to_date("filed_at").alias("as_of"), F.col("order_id").alias("ann_id"), F.bround(F.col("order_value_inr") / 1e9).alias("order_book_inr"), kind.alias("source_kind"), (F.pmod("order_id", F.lit(7)) / 10).alias("confidence"), "filed_at", F.when(F.col("order_id") % 3 == 0, "stated").otherwise("filed").alias("as_of_basis"), F.when(F.col("order_id") % 4 == 0, "segment").otherwise("total").alias("scope"), F.when(F.col("order_id") % 13 == 0, F.array(F.lit("unit error"))).otherwise(F.array().cast("array<string>")).alias("flags"))


_P = _F + """, p AS (SELECT company_id, CAST(filed_at AS DATE) AS as_of, order_id AS ann_id, round_even(order_value_inr / 1e9, 0) AS order_book_inr, CASE order_id % 5 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN -2 WHEN 3 THEN -3 ELSE -2 END AS rnk, (order_id % 7) / 10.0 AS confidence, filed_at,
 CASE WHEN order_id % 3 = 0 THEN 'stated' ELSE 'filed' END AS as_of_basis, order_id % 4 <> 0 AS is_total, order_id % 13 = 0 AS flagged, year(filed_at) || 'Q' || quarter(filed_at) AS quarter FROM f),
 b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY company_id, quarter ORDER BY rnk DESC, as_of DESC, confidence DESC, filed_at DESC, ann_id DESC) = 1)"""


@query(_P + "SELECT company_id, quarter, ann_id, order_book_inr FROM b")
def best_per_quarter(spark, sf):
    """W5."""
    return sequences.best_per_quarter(_points(spark, sf)).select("company_id", "quarter", "ann_id", "order_book_inr")


_FOLD = """, o AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY as_of) AS k FROM {src}),
 w AS (SELECT company_id, k, as_of, order_book_inr, order_book_inr AS last, true AS kept FROM o WHERE k = 1 UNION ALL
  SELECT o.company_id, o.k, o.as_of, o.order_book_inr, CASE WHEN abs(o.order_book_inr - w.last) < {tol} AND o.as_of_basis <> 'stated' THEN w.last ELSE o.order_book_inr END, NOT (abs(o.order_book_inr - w.last) < {tol} AND o.as_of_basis <> 'stated') FROM w JOIN o ON o.company_id = w.company_id AND o.k = w.k + 1)"""


@query(_P + _FOLD.format(src="b", tol="5.0") + " SELECT company_id, as_of, order_book_inr FROM w WHERE kept")
def restated_dropped(spark, sf):
    """W6, with a tolerance that fits these values."""
    best = sequences.best_per_quarter(_points(spark, sf)).select("company_id", "as_of", "order_book_inr", "as_of_basis")
    return sequences.drop_restated(best, 5.0).select("company_id", "as_of", "order_book_inr")


@query(_P.replace("FROM p QUALIFY", "FROM (SELECT * FROM (SELECT *, bool_or(is_total AND NOT flagged) OVER (PARTITION BY company_id) AS has_total FROM p) WHERE NOT flagged AND (NOT has_total OR is_total)) QUALIFY") + _FOLD.format(src="b", tol="1e5") + " SELECT company_id, as_of, order_book_inr FROM w WHERE kept")
def orderbook_series(spark, sf):
    """W4-W7 end to end."""
    return sequences.build_series(_points(spark, sf)).select("company_id", "as_of", "order_book_inr")


@query(_P + """, s AS (SELECT company_id, as_of, order_book_inr, max(as_of) OVER (PARTITION BY company_id) AS last_of, arg_max(order_book_inr, as_of) OVER (PARTITION BY company_id) AS last_v, lag(order_book_inr) OVER (PARTITION BY company_id ORDER BY as_of) AS prev FROM b),
 g AS (SELECT company_id, min(as_of) AS from_as_of, arg_min(order_book_inr, as_of) AS from_value, any_value(last_of) AS last_of, any_value(last_v) AS last_v FROM s WHERE last_of - as_of BETWEEN 60 AND 366 GROUP BY 1)
 SELECT g.company_id, round(g.last_v / from_value - 1, 6) AS pct, g.from_as_of, from_value, CAST(g.last_of - g.from_as_of AS INTEGER) AS days, bool_or(s.as_of > g.from_as_of AND s.prev <> 0 AND NOT (s.order_book_inr / s.prev > 0.25 AND s.order_book_inr / s.prev < 4)) AS suspect
 FROM g JOIN s ON s.company_id = g.company_id AND s.as_of >= g.from_as_of WHERE from_value <> 0 GROUP BY ALL""")
def growth_period(spark, sf):
    """W8, W9, W11, R11 over a year."""
    best = sequences.best_per_quarter(_points(spark, sf)).select("company_id", "as_of", "order_book_inr")
    return sequences.growth(best, 366).withColumn("pct", F.round("pct", 6))


def _twice(spark, sf) -> DataFrame:
    """Every third order is filed on the other exchange too, a day later, for some without its value."""
    f = base.filings(spark, sf).withColumn("score", F.col("firmness"))
    again = f.filter("order_id % 3 = 0").withColumns({"filed_at": F.timestamp_add("HOUR", F.lit(5), F.col("filed_at")), "exchange": F.when(F.col("exchange") == "NSE", "BSE").otherwise("NSE"), "order_value_inr": F.when(F.col("order_id") % 2 == 0, F.col("order_value_inr")), "order_id": F.col("order_id") + 10_000_000})
    return f.unionByName(again)


@query(_F + """, t AS (SELECT order_id, company_id, exchange, order_value_inr AS v, filed_at, order_type, execution_months, firmness AS score FROM f UNION ALL SELECT order_id + 10000000, company_id, CASE WHEN exchange = 'NSE' THEN 'BSE' ELSE 'NSE' END, CASE WHEN order_id % 2 = 0 THEN order_value_inr END, filed_at + INTERVAL 5 HOUR, order_type, execution_months, firmness FROM f WHERE order_id % 3 = 0),
 n AS (SELECT *, CAST(epoch(filed_at) AS BIGINT) AS sec, row_number() OVER (PARTITION BY company_id ORDER BY filed_at DESC, order_id) AS k FROM t),
 r AS (SELECT company_id, k, [{'k': k, 'v': v, 'sec': sec, 't': order_type}] AS heads, k AS head FROM n WHERE k = 1 UNION ALL
  SELECT company_id, k, CASE WHEN found IS NULL THEN list_append(heads, {'k': k, 'v': v, 'sec': sec, 't': order_type}) ELSE heads END, coalesce(found, k) FROM (SELECT n.company_id, n.k, n.v, n.sec, n.order_type, r.heads,
   list_filter(r.heads, lambda h: CASE WHEN h.v IS NOT NULL AND n.v IS NOT NULL THEN abs(h.v - n.v) <= greatest(1.0, h.v * 0.005::DOUBLE) AND abs(floor((h.sec - n.sec) / 86400)) <= 3 ELSE h.sec // 86400 = n.sec // 86400 AND h.t = n.order_type END)[1].k AS found FROM r JOIN n ON n.company_id = r.company_id AND n.k = r.k + 1)),
 j AS (SELECT n.*, r.head FROM n JOIN r ON r.company_id = n.company_id AND r.k = n.k)
 SELECT company_id, arg_min(order_id, z) AS order_id, arg_min(v, z) FILTER (v IS NOT NULL) AS order_value_inr, list_sort(list(DISTINCT exchange)) AS exchanges, count(*) AS duplicate_filings FROM (SELECT *, row_number() OVER (PARTITION BY company_id, head ORDER BY v IS NOT NULL DESC, execution_months IS NOT NULL DESC, score DESC, filed_at DESC, order_id) AS z FROM j) GROUP BY company_id, head""")
def collapse_exchanges(spark, sf):
    """W2, W3, A10 on the filings of every company."""
    return sequences.collapse(_twice(spark, sf))


@query(O["collapse_exchanges"])
def collapse_exchanges_all(spark, sf):
    """The same as `collapse_exchanges`, under the name it had while that was a part."""
    return sequences.collapse(_twice(spark, sf))


@query("SELECT event_type AS feed, event_id AS run_id FROM (SELECT *, bool_and(value < 40) OVER w AND count(*) OVER w = 3 AS alarm FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE alarm")
def feed_alarm(spark, sf):
    """A small value stands for a failed run."""
    e = base.table(spark, sf, "events").select(F.col("event_type").alias("feed"), F.col("event_id").alias("run_id"), (F.col("value") < 40).alias("failed"))
    return sequences.feed_alarm(e).select("feed", "run_id")


@query(_F + """, a AS (SELECT company_id, year(filed_at) + CASE WHEN month(filed_at) >= 4 THEN 1 ELSE 0 END AS fy, sum(CAST(round(order_value_inr / 1e3) AS BIGINT))::BIGINT AS sales FROM f GROUP BY ALL)
 SELECT f.order_id, CAST(a.fy AS INTEGER) AS fy, a.sales FROM (SELECT *, year(filed_at) + CASE WHEN month(filed_at) >= 4 THEN 1 ELSE 0 END - 1 AS want FROM f) f ASOF LEFT JOIN a ON f.company_id = a.company_id AND f.want >= a.fy""")
def asof_fundamentals(spark, sf):
    """The last completed financial year before each filing."""
    f = base.filings(spark, sf).select("order_id", "company_id", "filed_at", "order_value_inr")
    a = f.groupBy("company_id", fiscal_year(F.col("filed_at")).alias("fy")).agg(F.sum(F.bround(F.col("order_value_inr") / 1e3).cast("long")).alias("sales"))
    return views.as_of(f, a, "company_id", fiscal_year(F.col("filed_at")) - 1, "fy", ["sales"]).select("order_id", "fy", "sales")


QUERIES, ORACLES = Q, O
