"""Queries of single rules: identities of one batch, stamps, hours, vetoes, answers of the disclosure table, votes, look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, filing, money, orderbook, text
from ..operators import entity, pages, views
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


@query("SELECT c_custkey AS company_id, n, 'IN' || c_custkey AS resolved FROM customer, (VALUES (1), (2), (3)) t(n)")
def batch_identity(spark, sf):
    """J13 in one batch: two names of one ISIN, and a filing that has the second name and a code only."""
    c = base.companies(spark, sf)
    k = F.col("company_id").cast("string")
    row = lambda n, tail, isin, code: F.struct(F.lit(n).alias("n"), F.concat("company_name", F.lit(tail)).alias("company_name"), (F.concat(F.lit("in"), k) if isin else F.lit(None).cast("string")).alias("isin"), F.lit(None).cast("string").alias("symbol"), (k if code else F.lit(None).cast("string")).alias("bse_code"))
    f = c.select("company_id", F.inline(F.array(row(1, " Alpha", True, False), row(2, " Beta", True, False), row(3, " Beta Limited", False, True))))
    known = c.limit(0).select(k.alias("company_id"), "company_name", F.lit(None).cast("string").alias("isin"))
    out = entity.resolve(f.withColumnRenamed("company_id", "who"), known)
    return out.select(F.col("who").alias("company_id"), "n", F.col("company_id").alias("resolved"))


_AT = "CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) + to_microseconds(o_orderkey % 1000000)"


@query(f"SELECT o_orderkey AS order_id, CASE o_orderkey % 6 WHEN 2 THEN date_trunc('second', t) WHEN 3 THEN date_trunc('minute', t) WHEN 4 THEN date_trunc('second', t) WHEN 5 THEN date_trunc('day', t) ELSE t END - INTERVAL 330 MINUTE AS at FROM (SELECT o_orderkey, {_AT} AS t FROM orders)")
def stamp_formats(spark, sf):
    """D14 in the forms of both venues, with fractions and without seconds."""
    o = base.filings(spark, sf)
    t = F.timestamp_add("MICROSECOND", F.col("order_id") % 1_000_000, F.timestamp_add("SECOND", F.col("order_id") % 86_400, F.col("filed_at")))
    forms = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd MMM yyyy HH:mm:ss", "yyyy-MM-dd"]
    said = F.element_at(F.array(*[F.date_format(t, f) for f in forms]), (F.col("order_id") % 6).cast("int") + 1)
    return o.select("order_id", calendar.stamp(said).alias("at"))


@query("SELECT o_orderkey AS order_id, isodow(l) <= 5 AND CAST(l AS TIME) BETWEEN TIME '09:00:00' AND TIME '18:00:00' AS inside FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) + INTERVAL 330 MINUTE AS l FROM orders)")
def market_hours_gate(spark, sf):
    """F9."""
    at = F.timestamp_add("SECOND", F.col("order_id") % 86_400, F.col("filed_at"))
    return base.filings(spark, sf).select("order_id", calendar.market_hours(at).alias("inside"))


@query("SELECT o_orderkey AS order_id, o_orderkey % 4 IN (0, 2) AS damaged FROM orders")
def rupee_damage_marks(spark, sf):
    """M13."""
    said = F.element_at(F.array(*map(F.lit, ("worth n 12 crore", "worth ₹12 crore", "of %5.5 lakhs", "won 12 crore"))), (F.col("order_id") % 4).cast("int") + 1)
    return base.filings(spark, sf).select("order_id", money.rupee_damage(said).alias("damaged"))


@query("SELECT c_custkey AS company_id, 'Telecom - Wire & Cable ' || c_mktsegment AS sector FROM customer")
def sector_labels(spark, sf):
    """S18's label."""
    page = F.concat(F.lit(" Telecom -  Wire &amp;\n Cable&nbsp;"), F.col("sector"), F.lit(" "))
    return base.companies(spark, sf).select("company_id", landed.sector_label(page).alias("sector"))


@query("SELECT user_id, event_type, n AS votes FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def majority_votes(spark, sf):
    """A15."""
    return views.majority(base.table(spark, sf, "events"), ["user_id"], "event_type")


@query("SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 <> 1 THEN (o_orderkey % 900 + 100) * 10000000 END AS value FROM orders")
def order_book_vetoes(spark, sf):
    """A figure that is billed or executed is not the book; one before the label still is."""
    f = base.filings(spark, sf, heavy=True)
    crore = (F.col("order_id") % 900 + 100).cast("string")
    said = F.when(F.col("order_id") % 3 == 0, F.concat(F.lit("Of the Rs "), crore, F.lit(" crore order book open on 1 April, Rs 23 crores is billed."))).when(F.col("order_id") % 3 == 1, F.lit("From the order book Rs 23 crores has been executed.")).otherwise(F.concat(F.lit("Our order book stands at Rs "), crore, F.lit(" crore.")))
    best = F.get(orderbook.find_order_books(said, F.to_date("filed_at"), F.lit("update")), 0)
    return f.select("order_id", F.bround(best["value_inr"]).cast("long").alias("value"))


@query("""SELECT o_orderkey AS order_id, (o_orderkey % 900 + 100) * 10000000 AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'NTPC Limited' END AS customer, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 36 + 1 AS DOUBLE) END AS months, 'work order' AS order_type, 0.8::DOUBLE AS firmness,
 round(least(0.95, 0.9 + CASE WHEN o_orderkey % 2 = 0 THEN 0.08 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS confidence FROM orders""")
def table_answers(spark, sf):
    """The disclosure table inside the extraction, and what corroborates a reading."""
    f = base.filings(spark, sf, heavy=True)
    k, none = F.col("order_id"), F.lit(None).cast("string")
    answers = [F.when(k % 2 == 0, "M/s. NTPC Limited").alias("t_customer"), F.concat(F.lit("Rs "), (k % 900 + 100).cast("string"), F.lit(" crore")).alias("t_size"), F.when(k % 3 == 0, F.concat((k % 36 + 1).cast("string"), F.lit(" months"))).alias("t_period")]
    f = f.select("order_id", F.lit("Receipt of contract").alias("headline"), F.lit("The company has received a contract.").alias("body"), none.alias("attachment"), none.alias("subcategory"), F.lit("Our Own Pumps Limited").alias("company_name"), "filed_at", *answers)
    e = filing.extract(f)
    return e.select("order_id", F.bround("order_value_inr").cast("long").alias("value"), "customer", F.col("execution_months").alias("months"), "order_type", "firmness", F.round("extraction_conf", 6).alias("confidence"))


_KINDS = ["Earnings Call Transcript", "Investor Presentation", "Annual Report", "Order Book update", "Financial Results", "Press Release", "General"]


@query("SELECT o_orderkey AS order_id, ['transcript', 'presentation', 'annual', 'update', 'results', 'press_release', 'other'][o_orderkey % 7 + 1] AS kind, o_orderkey % 7 = 3 AS mentions FROM orders")
def document_kinds(spark, sf):
    """T16, F11."""
    said = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("order_id") % 7).cast("int") + 1)
    return base.filings(spark, sf).select("order_id", text.document_kind(F.lit(""), F.lit(""), said, F.lit(False)).alias("kind"), text.mentions_book(said).alias("mentions"))


@query("SELECT ['transcript', 'presentation', 'annual', 'update', 'results', 'press_release', 'other'][o_orderkey % 7 + 1] AS kind, count(*) AS n FROM orders GROUP BY 1")
def candidate_kinds(spark, sf):
    """How many candidates there are of each kind."""
    said = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("order_id") % 7).cast("int") + 1)
    return views.kinds(base.filings(spark, sf).select(text.document_kind(F.lit(""), F.lit(""), said, F.lit(False)).alias("kind")))


@query("SELECT c_custkey AS company_id FROM customer WHERE c_acctbal >= 1000 AND c_custkey % 3 <> 0 AND c_name ILIKE '%1%' AND c_custkey % 5 <> 0")
def book_page_rows(spark, sf):
    """the filter of the order-book page; companies without a market cap fall out under a least one."""
    c = base.companies(spark, sf)
    k = F.col("company_id")
    rows = c.select("company_id", "company_name", F.col("balance").alias("order_book_inr"), F.when(k % 3 == 0, "segment").otherwise("total").alias("scope"), F.lit("S").alias("symbol"), F.when(k % 5 != 0, 2e9).alias("market_cap_inr"))
    return pages.book_page(rows, least_book=1000, least_cap=1e9, segments=False, name="1").select("company_id")


@query("SELECT c_custkey AS company_id, c_name AS company_name FROM customer WHERE c_custkey = 7")
def company_lookup(spark, sf):
    """F16: one company by symbol, code, id or a part of its name."""
    k = F.col("company_id").cast("string")
    c = base.companies(spark, sf).select(F.col("company_id").alias("n"), F.concat(F.lit("ID"), k).alias("company_id"), F.concat(F.lit("SYM"), k).alias("symbol"), F.concat(F.lit("9"), k).alias("bse_code"), "company_name")
    return pages.find_company(c, "sym7").select(F.col("n").alias("company_id"), "company_name")


QUERIES, ORACLES = Q, O
