"""Text functions on cases stated as data: text in, fields out."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, money, orderbook, text

from .order_book_cases import CASES

VALUES = [
    ("order value of Rs. 125.50 Crore (excluding GST)", 125.5e7), ("worth Rs.1307 Crore", 1307e7), ("contract valued at INR 12,55,00,000", 12.55e7), ("₹ 1255 Lakhs work order worth", 12.55e7),
    ("export order worth USD 4.2 Mn", 4.2e6 * 88), ("between Rs 50 crore and Rs 60 crore", 55e7), ("Rs 100 - 120 crore", 110e7), ("EMD of Rs 2.5 crore; the order value is Rs 425 crore", 425e7),
    ("Size of the order 4,23,00,000", 4.23e7), ("paid-up capital of Rs 5 crore", None), ("clause 12 of 2024", None), ("worth %10.07 Lacs", 10.07e5), (None, None), ("", None),
]


@pytest.mark.parametrize("said, value", VALUES)
def test_order_value(said, value):
    got = money.order_value(said)
    assert (got and round(got.value_inr)) == (value and round(value))


def test_scanned_units_are_repaired():
    assert [round(a.value_inr) for a in money.amounts("worth n 0.07 crorcs and 9 - I1 crores")] == [100_000_000, 700_000]


def test_guidance():
    said = "The plant runs. In Current F.Y. 2026-27 we are expecting Total Income of Rs 105 crores with PAT of minimum Rs 5 - 7 crores. We are targeting additional turnover of Rs 3 crores from above client in FY27. Revenue is expected to show growth of 25% in FY28."
    got = {(g["fy_end"], g["metric"]): (g["low_inr"], g["growth_low"]) for g in money.guidance(said, 2027)}
    assert got == {(2027, "revenue"): (105e7, None), (2027, "pat"): (5e7, None), (2028, "revenue"): (None, 0.25)}
    assert money.guidance(None, 2027) == money.guidance("Revenue was Rs 5 crore in FY20.", 2027) == []


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[0]} {c[1][:20]}")
def test_order_book(case):
    _, said, filed, kind, crore, at, scope = case
    got = orderbook.order_books(said, date.fromisoformat(filed), kind)
    if crore is None:
        assert not got
    else:
        assert abs(got[0]["value_inr"] / 1e7 - crore) <= crore * 0.01 and got[0]["scope"] == scope
        assert at is None or got[0]["as_of"].isoformat() == at


def test_order_book_column(spark):
    d = spark.createDataFrame([("Order book of Rs 21.5 crore as on 15.05.2024.", date(2024, 6, 3), "order_win"), (None, None, None)], "t string, d date, k string")
    got = [r.b for r in d.select(orderbook.best_order_book(orderbook.find_order_books("t", "d", "k")).alias("b")).collect()]
    assert got[0].value_inr == 21.5e7 and got[0].as_of == date(2024, 5, 15) and got[1] is None


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("said, months", [("to be completed within 18 months", 18), ("over a period of Twenty-Four Months", 24), ("Time period by which the order is to be executed     45 Days.", 45 / 30.44), ("for a period of two years", 24), ("6 weeks from the date of order", 6 / 4.33), ("completed by Mar 2028", 17), ("nothing here", None), ("within 900 years", None)])
def test_duration(spark, said, months):
    got = one(spark, calendar.duration_months(F.lit(said), F.lit("2026-10-18").cast("date")))
    assert got is None if months is None else abs(got - months) < 0.01


@pytest.mark.parametrize("day, fy, quarter, year_end", [("2026-08-03", 2027, "2026-06-30", "2026-03-31"), ("2026-03-31", 2026, "2025-12-31", "2025-03-31"), ("2026-06-30", 2027, "2026-03-31", "2026-03-31"), ("2024-02-29", 2024, "2023-12-31", "2023-03-31")])
def test_calendar(spark, day, fy, quarter, year_end):
    d = F.lit(day).cast("date")
    got = spark.range(1).select(calendar.fiscal_year(d), calendar.quarter_end_before(d).cast("string"), calendar.fiscal_year_end_before(d).cast("string")).first()
    assert tuple(got) == (fy, quarter, year_end)


def test_names_and_customers(spark):
    key = lambda n: one(spark, text.company_key(F.lit(n)))
    assert key("Star Paper Mills Limited") == key("STAR PAPER MILLS LTD-$") == "STARPAPERMILLS" and key(None) == ""
    got = one(spark, text.customer(F.lit("Received a work order from M/s. Larsen & Toubro Limited for pumps"), F.lit("Alpha Infra Ltd")))
    assert got.name.startswith("Larsen & Toubro") and not got.is_self
    assert one(spark, text.customer(F.lit("a work order placed by Alpha Infra Ltd for its unit"), F.lit("Alpha Infra Limited"))).is_self


def test_headlines(spark):
    assert one(spark, text.looks_like_order(F.lit("Bagging/Receiving of orders/contracts"), F.lit(None).cast("string")))
    assert one(spark, text.non_order(F.lit("Receipt of purchase order"), F.lit(None).cast("string"))) is None
    assert one(spark, text.non_order(F.lit("Receipt of order from BSE"), F.lit("x"))) == "order from bse"
    assert one(spark, text.own_project(F.lit("Letter of Intent for setting up a plant with capital expenditure of Rs 25 crore funded through internal accruals")))
    assert one(spark, text.order_type(F.lit("signed an MoU for supply")))["firmness"] == 0.3
    assert one(spark, text.yes_no(F.lit("No, it is not"))) is False and one(spark, text.yes_no(F.lit("Yes"))) is True
    assert one(spark, text.clean_html(F.lit("<p>A&nbsp;&amp; B</p>\n"))) == "A & B" and one(spark, text.clean_html(F.lit("<br>"))) is None


def test_every_document_is_scored(spark, tmp_path):
    import duckdb

    from tidemark.plans import catalogue

    said = {1: ("Tentative and estimated: L1 for a road", -0.25), 2: ("ROADS, broad; l10 untentative", 0.0), 3: (None, 0.0), 4: ("", 0.0), 5: ("road", -0.05), 6: ("export of civil work, subject to license", 0.02), 7: ("lowest bidder l1 road civil work building construction subject to tentative estimated", -0.4), 8: ("defence export semiconductor annuity", 0.5), 9: ("defence export semiconductor annuity_road", 0.5), 10: ("a\nroad\n", -0.05)}
    spark.createDataFrame([(k, t) for k, (t, _) in said.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.points, r.licensed) for r in catalogue.QUERIES["document_quality_all"](spark, str(tmp_path)).collect())
    assert got == [(k, p, None if t is None else k == 6) for k, (t, p) in said.items()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(catalogue.ORACLES["document_quality_all"]).fetchall()) == got
