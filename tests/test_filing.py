"""Filings in, orders out: statements, vetoes, table answers, summaries."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import filing, markup
from tidemark.sources import landed

STATEMENTS = [
    ("The Company has received a purchase order from Godrej Properties", True), ("Order has been placed on us", True), ("Receipt of LOI", True), ("Alpha secures landmark Order", True), ("contract win of Rs 85.53 Crore", True),
    ("Whether order(s) have been awarded by domestic/international entity", False), ("has received the approval order from the Regional Director", False), ("to be finalized after receipt of Letter of Acceptance", False), ("has not received any order", False), ("Quarterly results", False), (None, False),
]


@pytest.mark.parametrize("said, yes", STATEMENTS)
def test_receipt(said, yes):
    assert (filing.receipt(said) is not None) == yes


def test_scope():
    what = filing.scope("We have received a work order from NTPC Limited for design and supply of control cables worth Rs 12 crore, to be completed within 6 months.")
    assert what == "design and supply of control cables"
    assert filing.scope("for your information and records") is None


def row(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_table_answers(spark):
    day = F.lit("2026-01-31").cast("date")
    r = row(spark, a=filing.period_months(F.lit("12 - 18 months"), day), b=filing.period_months(F.lit("One Year"), day), c=filing.period_months(F.lit("by 31.07.2026"), day), d=filing.end_date(F.lit("on or before 5th March, 2027")), e=filing.end_date(F.lit("June 30, 2026")), f=filing.table_size(F.lit("R s. 12.5 Crore")), g=filing.table_size(F.lit("4,23,00,000")), h=filing.table_size(F.lit("NA")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (18.0, 12.0, 6.0, date(2027, 3, 5), date(2026, 6, 30), 12.5e7, 4.23e7, None)


def test_related_party(spark):
    r = row(spark, a=filing.related_party(F.lit("awarded by its holding company")), b=filing.related_party(F.lit("Whether the promoter group have any interest: No")), c=filing.related_party(F.lit("nothing")))
    assert r.a and not r.b and not r.c


def test_extract(spark):
    rows = [
        (1, "Award of order", "The company has received a letter of award from Jal Nigam worth Rs. 420.50 Cr over a period of 24 months", None), (2, "Board Meeting Intimation", "A meeting is called", None), (3, "Cancellation of order", "The work order of Rs 150 Cr is cancelled", None),
        (4, "Letter of Intent for setting up a plant", "capital expenditure of Rs 25 crore funded through internal accruals; work order", None), (5, None, None, None), (6, "Declared L1", "emerged as lowest bidder for the contract", None), (7, "Receipt of order from SEBI", "order received", None),
    ]
    d = spark.createDataFrame([(i, h, b, a, None, "Alpha Infra Ltd", datetime(2026, 5, 1)) for i, h, b, a in rows], "k int, headline string, body string, attachment string, subcategory string, company_name string, filed_at timestamp")
    got = {r.k: r for r in filing.extract(d).collect()}
    assert {k for k, r in got.items() if r.is_order} == {1, 3} and len(got) == 7
    assert got[1].order_value_inr == 420.5e7 and got[1].execution_months == 24 and got[1].customer == "Jal Nigam" and got[1].firmness == 1.0 and not got[1].needs_check
    assert got[3].is_amendment and got[3].firmness == 0 and got[3].order_value_inr == 150e7


PAGE = """<h1>X</h1>Market Cap <b>1,234</b> Cr. Consolidated Figures<section id="profit-loss"><table><tr><th></th><th>Mar 2025</th><th>Mar 2026</th></tr>
<tr><td>Sales +</td><td>32.97</td><td>1,105</td></tr><tr><td>Other Income</td><td>1</td><td>2</td></tr><tr><td>Net Profit</td><td>0.54</td><td>-5</td></tr></table></section>"""


def test_company_page(spark):
    r = row(spark, cap=markup.market_cap(F.lit(PAGE)), basis=markup.basis(F.lit(PAGE)), years=markup.annuals(F.lit(PAGE)), none=markup.market_cap(F.lit("no")))
    assert round(r.cap) == 1234 * 10**7 and r.basis == "consolidated" and r.none is None
    assert [(y.fy, round(y.sales), round(y.other_income), round(y.net_profit)) for y in r.years] == [(2025, 329_700_000, 10_000_000, 5_400_000), (2026, 11_050_000_000, 20_000_000, -50_000_000)]


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("key,q_revenue_cr,ttm_revenue_cr,ebitda_margin,market_cap_cr,latest_quarter\n# a note,1,1,1,1,x\nbeta,10,0,0.2,500,2026Q1\n")
    r = landed.manual(spark, str(tmp_path / "m.csv")).collect()
    assert [(x.key, x.q_revenue_inr, x.ttm_revenue_inr) for x in r] == [("BETA", 10e7, None)]
    raw = spark.createDataFrame([("1", "", "beta", "-", None, "", "Updates", "<p>Got an order</p>", "http://x/a.pdf", "01-Oct-2026 10:00:00", None, True)], "seq_id string, an_id string, symbol string, sm_name string, sm_isin string, smIndustry string, desc string, attchmntText string, attchmntFile string, an_dt string, exchdisstime string, is_sme boolean")
    n = landed.nse(raw).first()
    assert (n.symbol, n.company_name, n.isin, n.body, n.filed_at, n.is_sme) == ("BETA", "beta", None, "Got an order", datetime(2026, 10, 1, 4, 30), True)
    w = row(spark, w=landed.history_windows(F.lit("2026-03-15").cast("date"), 10)).w
    assert [(str(x["from"]), str(x["to"])) for x in w] == [("2026-03-08", "2026-03-14"), ("2026-03-05", "2026-03-07")]


def test_table_overrides(spark):
    cols = "order_value_inr double, extraction_conf double, execution_months double, customer string, customer_type string, is_related_party boolean, scope string, filed_at timestamp, t_customer string, t_size string, t_period string, t_related string, t_domestic string, t_nature string"
    at = datetime(2026, 1, 31)
    rows = [(10e7, 0.5, None, None, "unknown", False, "pumps", at, "M/s NTPC Limited", "Rs 12.5 Crore", "18 months", "Yes", "Domestic", "supply of pumps and motors"), (10e7, 0.5, 6.0, "Acme", "private", True, "pumps", at, None, None, None, "No", "International", None)]
    a, b = filing.apply_table(spark.createDataFrame(rows, cols)).collect()
    assert (a.order_value_inr, a.execution_months, a.customer, a.customer_type, a.is_related_party, a.scope) == (12.5e7, 18.0, "NTPC Limited", "psu", True, "supply of pumps and motors")
    assert (b.order_value_inr, b.extraction_conf, b.execution_months, b.customer, b.customer_type, b.is_related_party) == (10e7, 0.5, 6.0, "Acme", "export", False)


def test_feed_warnings_once_a_day(spark):
    from tidemark.streaming import ingest

    runs = [("bse", k, True, datetime(2026, 1, 1 + k // 24, k % 24)) for k in range(60)] + [("nse", k, k % 3 == 0, datetime(2026, 1, 1, k % 24)) for k in range(20)]
    got = ingest.feed_warnings(spark.createDataFrame(runs, "feed string, run_id int, failed boolean, at timestamp")).collect()
    assert sorted((r.feed, r.run_id) for r in got) == [("bse", 2), ("bse", 27), ("bse", 52)]


def test_alerts_leave_out_twins(spark):
    from tidemark.operators import views
    from tidemark.streaming import ingest

    at = datetime(2026, 1, 1)
    o = spark.createDataFrame([(1, 7, 100e7, at, "HIGH"), (2, 7, 100.2e7, at, "HIGH"), (3, 8, 100e7, at, "WATCH"), (4, 9, 5e7, at, "MEDIUM")], "order_id long, company_id long, order_value_inr double, filed_at timestamp, tier string")
    assert sorted(r.order_id for r in ingest.to_alert(o).collect()) == [1, 4]
    assert sorted(map(tuple, views.difference(o.filter("order_id < 3"), o.filter("order_id > 1"), "order_id").collect())) == [(1, "removed"), (3, "added"), (4, "added")]


def test_summaries(spark):
    rows = [
        ("design and supply of control cables", "NTPC Limited", "work order", 12e7, 6.0, None),
        ("supply of " + "very long description " * 20, "A Customer With A Name", "loa", 27.72e7, 24.0, None),
        (None, "Northern Power Distribution Company of Telangana Limited (TG NPDCL)", "mou", None, 1.0, None),
        (None, None, "work order", 5.5e6, None, "Award of a rail contract"), (None, "lower case", "loi", 5e5, 3.0, None), (None, None, None, None, None, None),
        ("for the upkeep of roads", "Steel Authority of India Limited, Plant Number One", None, None, 1.5, None),
    ]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, what string, customer string, kind string, value double, months double, title string")
    got = [r.summary for r in filing.summarise(d, "what", F.col("customer"), "kind", "value", "months", F.col("title")).orderBy("k").collect()]
    assert got[0] == "₹12 Cr order from NTPC for design and supply of control cables, over 6 months."
    assert got[1].startswith("₹27.72 Cr Letter of Award from a Customer With A Name for supply of very long") and got[1].endswith(", over 2 years.") and len(got[1]) <= filing.LONGEST
    assert got[2] == "MoU with TG NPDCL, over 1 month."
    assert got[3] == "Award of a rail contract (₹55 L)." and got[4] is None and got[5] is None
    assert got[6] == "Order from Steel Authority of India for the upkeep of roads, over 46 days."


def test_titles_and_tables(spark):
    said = "Name of the entity awarding the order(s)/contract(s) M/s. Jal Vitaran Nigam; Nature of order(s)/contract(s) Laying of water mains in two towns Whether domestic or international Domestic Time period 12 months"
    rows = [
        ("General Updates", 'A release titled "Company wins a large water project".', None), ("Update", "Company has informed the Exchange about receipt of a large repeat order for pumps.", None),
        ("Large repeat order for pumps won by us.", "", None), ("Intimation under the rules of the exchange", "", None), ("Contract", said, None), (None, None, None),
    ]
    d = spark.createDataFrame([(k, *r, None, "work order", None, None) for k, r in enumerate(rows)], "k int, headline string, body string, attachment string, customer string, order_type string, order_value_inr double, execution_months double")
    got = filing.describe(d).withColumn("title", filing.fallback_title(F.col("headline"), F.col("body"))).orderBy("k").collect()
    assert [r.title for r in got[:4]] == ["Company wins a large water project", "Receipt of a large repeat order for pumps", "Large repeat order for pumps won by us", None]
    assert (got[4].scope, got[4].stated_customer) == ("Laying of water mains in two towns", "Jal Vitaran Nigam")
    assert got[4].summary == "Order from Jal Vitaran Nigam for Laying of water mains in two towns."
    assert got[5].summary is None and got[5].scope is None
