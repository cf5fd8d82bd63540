"""Text queries. The tables hold hardly any filing text, so it is rendered from their columns and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, money, text
from ..functions.calendar import duration_months, fiscal_year, period_text
from ..operators import entity
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


def _rendered(spark, sf):
    return base.filings(spark, sf, heavy=True).join(base.companies(spark, sf), "company_id").withColumn("text", base.filing_text())


@query("SELECT o_orderkey AS order_id, CAST(round(round(o_totalprice, 2) * 1e5) AS BIGINT) AS value, CAST(o_orderkey % 36 + 1 AS DOUBLE) AS months FROM orders")
def rendered_value(spark, sf):
    """M1-M4, D2, D4 on the JVM: the round trip of a whole sentence."""
    r = _rendered(spark, sf)
    return r.select("order_id", F.bround(money.simple_value(F.col("text"))).cast("long").alias("value"), duration_months(F.col("text"), F.col("filed_at")).alias("months"))


@query("SELECT o_orderkey AS order_id, CAST(round(round(o_totalprice, 2) * 1e5) AS BIGINT) AS value, 'INR' AS currency, false AS is_range FROM orders")
def rendered_pick(spark, sf):
    """M5-M10 with offsets: the order value among an earnest-money deposit and a guarantee."""
    r = _rendered(spark, sf)
    t = F.concat(F.lit("Earnest money deposit of Rs. 2.5 Lakh was paid. "), "text", F.lit(" A bank guarantee of Rs. 1.25 Lakh applies."))
    r = r.select("order_id", money.pick_order_value(t).alias("a"))
    return r.select("order_id", F.bround("a.value_inr").cast("long").alias("value"), "a.currency", "a.is_range")


@query("SELECT o_orderkey AS order_id, CAST(round(CASE o_orderkey % 3 WHEN 0 THEN 88 WHEN 1 THEN 96 ELSE 112 END * CAST(o_orderkey % 500 + 1 AS DOUBLE) * 1e6) AS BIGINT) AS value, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency FROM orders")
def rendered_currency(spark, sf):
    """M2, M4, M8."""
    sign = F.element_at(F.array(F.lit("USD"), F.lit("€"), F.lit("£")), (F.col("order_id") % 3).cast("int") + 1)
    t = F.concat(F.lit("an export order worth "), sign, F.lit(" "), (F.col("order_id") % 500 + 1).cast("string"), F.lit(" million"))
    r = base.filings(spark, sf, heavy=True).select("order_id", F.get(money.extract_amounts(t), 0).alias("a"))
    return r.select("order_id", F.bround("a.value_inr").cast("long").alias("value"), "a.currency")


@query("SELECT o_orderkey AS order_id, true AS is_range, CAST((o_orderkey % 90 + 1) * 1e7 AS BIGINT) AS low, CAST((o_orderkey % 90 + 11) * 1e7 AS BIGINT) AS high, 'work order' AS order_type, 1.0::DOUBLE AS firmness FROM orders")
def rendered_range(spark, sf):
    """M8 ranges and T8."""
    n = F.col("order_id") % 90
    t = F.concat(F.lit("Work orders of Rs "), (n + 1).cast("string"), F.lit(" - "), (n + 11).cast("string"), F.lit(" crore"))
    r = base.filings(spark, sf, heavy=True).select("order_id", money.pick_order_value(t).alias("a"), text.order_type(t).alias("o"))
    return r.select("order_id", "a.is_range", F.bround("a.low_inr").cast("long").alias("low"), F.bround("a.high_inr").cast("long").alias("high"), "o.order_type", "o.firmness")


@query("SELECT o_orderkey AS order_id, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END + o_orderkey % 3 AS fy, CAST((o_orderkey % 900 + 100) * 1e7 AS BIGINT) AS revenue, CAST((o_orderkey % 50 + 1) * 1e7 AS BIGINT) AS pat FROM orders")
def rendered_guidance(spark, sf):
    """G1, D7, D8."""
    f = base.filings(spark, sf, heavy=True)
    fy = fiscal_year(F.col("filed_at")) + F.col("order_id") % 3
    t = F.format_string("The plant runs well. In FY%d we are expecting total income of Rs %d crores with PAT of minimum Rs %d - %d crores. Thank you.", fy, F.col("order_id") % 900 + 100, F.col("order_id") % 50 + 1, F.col("order_id") % 50 + 3)
    g = f.select("order_id", money.extract_guidance(t, fiscal_year(F.col("filed_at"))).alias("g"))
    pick = lambda m: F.get(F.filter("g", lambda i: i["metric"] == m), 0)
    return g.select("order_id", pick("revenue")["fy_end"].cast("long").alias("fy"), F.bround(pick("revenue")["low_inr"]).cast("long").alias("revenue"), F.bround(pick("pat")["low_inr"]).cast("long").alias("pat"))


@query("SELECT c_custkey AS company_id, regexp_replace(upper(c_name), '[^A-Z0-9]+', '', 'g') AS key FROM customer")
def company_keys(spark, sf):
    """T4: suffixes and the surveillance mark do not count."""
    c = base.companies(spark, sf)
    return c.select("company_id", text.company_key(F.concat("company_name", F.lit(" Private Ltd-$"))).alias("key"))


@query("SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 = 0 THEN 'IN' || c_custkey WHEN c_custkey % 3 = 1 THEN 'KNOWN' || c_custkey ELSE 'NSE:S' || c_custkey END AS resolved FROM customer")
def entity_merge(spark, sf):
    """By ISIN, by name, or a new id."""
    c = base.companies(spark, sf)
    k, third = F.col("company_id").cast("string"), F.col("company_id") % 3
    f = c.select(F.col("company_id").alias("n"), F.concat("company_name", F.lit(" Limited")).alias("company_name"), F.when(third == 0, F.concat(F.lit("in"), k)).alias("isin"), F.concat(F.lit("s"), k).alias("symbol"), F.lit(None).cast("string").alias("bse_code"))
    known = c.filter(third == 1).select(F.concat(F.lit("KNOWN"), k).alias("company_id"), F.upper("company_name").alias("company_name"), F.lit(None).cast("string").alias("isin"))
    return entity.resolve(f, known).select(F.col("n").alias("company_id"), F.col("company_id").alias("resolved"))


@query("SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS text FROM pages")
def html_clean(spark, sf):
    """T1."""
    return base.spread(base.table(spark, sf, "pages")).select("page_id", text.clean_html(F.col("html")).alias("text"))


@query("SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def html_title(spark, sf):
    """S13's pattern part."""
    p = base.table(spark, sf, "pages")
    return p.select("page_id", markup.title(F.col("html")).alias("title"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))


_BUMP = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {p}::DOUBLE ELSE 0.0 END" for w, p in (("export", 0.15), ("overseas", 0.12), ("international", 0.10), ("defence", 0.20), ("defense", 0.20), ("aerospace", 0.15), ("repeat order", 0.10), ("operation and maintenance", 0.12), ("o&m", 0.12), ("annuity", 0.15), ("ham", 0.10), ("semiconductor", 0.15), ("data centre", 0.12), ("data center", 0.12), ("railway", 0.05), ("metro", 0.05), ("transmission", 0.08)))


_DING = " + ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN {p}::DOUBLE ELSE 0.0 END" for w, p in (("lowest bidder", -0.10), ("l1", -0.05), ("road", -0.05), ("civil work", -0.08), ("building construction", -0.08), ("subject to", -0.05), ("tentative", -0.10), ("estimated", -0.05)))


@query(f"SELECT doc_id, round(greatest(-0.4, least(0.5, {_BUMP} + {_DING})), 6) AS bump, contains(lower(text), 'license') AS licensed FROM documents")
def document_quality_words(spark, sf):
    """T10, bumps and dings, on every document."""
    return document_quality_all(spark, sf).withColumnRenamed("points", "bump")


@query(f"SELECT doc_id, round(greatest(-0.4, least(0.5, {_BUMP} + {_DING})), 6) AS points, contains(lower(text), 'license') AS licensed FROM documents")
def document_quality_all(spark, sf):
    """T10, both halves, on every document. A null text has no words: no points, and null for what it holds."""
    d = base.spread(base.table(spark, sf, "documents"))
    return d.select("doc_id", F.round(text.quality_adjustment(F.col("text")), 6).alias("points"), F.contains(F.lower("text"), F.lit("license")).alias("licensed"))


_HEAD = ["Bagging/Receiving of orders/contracts", "Board Meeting Intimation", "Cancellation of work order", "Credit Rating reaffirmed by CRISIL", "General Updates", "Investor Presentation", "Order passed by SEBI", "Letter of Intent received"]
_CASE = lambda values: "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@query(f"SELECT o_orderkey AS order_id, {_CASE(['true', 'false', 'true', 'false', 'false', 'false', 'false', 'true'])} AS is_order_like, {_CASE(['NULL', 'NULL', 'NULL', repr('credit rating'), 'NULL', 'NULL', repr('order passed by sebi'), 'NULL'])} AS veto, {_CASE(['false'] * 4 + ['true'] + ['false'] * 3)} AS probe, {_CASE(['false', 'false', 'true'] + ['false'] * 5)} AS amendment, {_CASE(['0.5', '0.5', '1.0', '0.5', '0.5', '0.5', '0.5', '0.6'])}::DOUBLE AS firmness, {_CASE(['false'] * 5 + ['true', 'false', 'false'])} AS book FROM orders")
def headline_ladder(spark, sf):
    """F2-F4, F10, T8, T9 on eight headlines."""
    h = F.element_at(F.array(*map(F.lit, _HEAD)), (F.col("order_id") % 8).cast("int") + 1)
    f = base.filings(spark, sf, heavy=True).select("order_id", h.alias("h"))
    h = F.col("h")
    return f.select("order_id", text.looks_like_order(h).alias("is_order_like"), text.non_order(h).alias("veto"), text.worth_probe(h, F.lit("")).alias("probe"), text.amendment(h).alias("amendment"), text.order_type(h)["firmness"].alias("firmness"), text.book_candidate(h).alias("book"))


@query("SELECT o_orderkey AS order_id, ['psu', 'government', 'export', 'private'][o_orderkey % 4 + 1] AS kind, ['NTPC Limited', 'Jal Nigam', 'Acme Trading Qatar', 'Godrej Properties'][o_orderkey % 4 + 1] || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' Unit ' || o_orderkey % 9973 END AS customer FROM orders")
def customer_ladder(spark, sf):
    """The counterparty out of every order's sentence, and its kind."""
    k = F.col("order_id")
    name = F.element_at(F.array(*map(F.lit, ("NTPC Limited", "Jal Nigam", "Acme Trading Qatar", "Godrej Properties"))), (k % 4).cast("int") + 1)
    name = F.concat(name, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" Unit "), (k % 9973).cast("string"))))
    s = base.filings(spark, sf, heavy=True).select("order_id", F.concat(F.lit("We have received a work order from "), name, F.lit(" for pumps")).alias("t"))
    s = s.withColumn("c", text.customer(F.col("t"), F.lit("Our Own Pumps Limited")))
    return s.select("order_id", text.customer_type(F.col("c.name"), F.lit("")).alias("kind"), F.col("c.name").alias("customer"))


@query("SELECT o_orderkey AS order_id, '<b>' || replace(replace(replace(c_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</b> ' || CASE WHEN o_totalprice * 1e5 >= 1e7 THEN 'Rs ' || format('{:,.2f}', o_totalprice * 1e5 / 1e7) || ' Cr' WHEN o_totalprice >= 1 THEN 'Rs ' || format('{:,.2f}', o_totalprice) || ' L' END || CASE WHEN o_orderkey % 36 + 1 IN (24, 36) THEN ' over ' || CAST((o_orderkey % 36 + 1) / 12 AS INTEGER) || ' years' ELSE ' over ' || (o_orderkey % 36 + 1) || ' months' END AS message FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def digest_messages(spark, sf):
    """The top 25 as messages."""
    r = base.filings(spark, sf).join(base.companies(spark, sf), "company_id").orderBy(F.desc("order_value_inr"), "order_id").limit(25)
    return r.select("order_id", F.concat(F.lit("<b>"), text.escape(F.col("company_name")), F.lit("</b> "), money.rupees(F.col("order_value_inr")), F.lit(" over "), period_text(F.col("execution_months"))).alias("message"))


QUERIES, ORACLES = Q, O
