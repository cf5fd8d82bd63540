"""Work over stored tables: rescore, recheck, near values and years against brute force, messages with notes and links."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import filing, scoring
from tidemark.operators import pages, replay, views

AT = datetime(2026, 1, 1)


def stored(spark):
    cols = "order_id string, company_id string, company_name string, filed_at timestamp, order_value_inr double, execution_months double, order_type string, is_amendment boolean, is_related_party boolean, extraction_conf double, breakdown string"
    told = '{"components": {"firmness": {"firmness": 1.0}, "margin_quality": {"keyword_adj": 0.15}}}'
    rows = [("a", "c", "C", AT, 5e8, 12.0, "loi", False, False, 0.8, told), ("b", "c", "C", AT + timedelta(9), 7e8, 24.0, "loi", False, False, 0.8, None), ("d", "x", "X", AT, None, None, None, None, None, None, "{not json"), ("e", "c", "C", AT, 9e8, 12.0, "amendment", True, False, 0.8, None)]
    return spark.createDataFrame(rows, cols)


def test_rescore_is_a_fixed_point(spark):
    filings = spark.createDataFrame([("a", AT + timedelta(hours=60)), ("b", AT + timedelta(9))], "ann_id string, seen_at timestamp")
    companies = spark.createDataFrame([("c", False, 1e10)], "company_id string, is_sme boolean, market_cap_inr double")
    figures = spark.createDataFrame([("c", 1e9, 4e9, 0.15)], "company_id string, q_revenue_inr double, ttm_revenue_inr double, ebitda_margin double")
    once = replay.rescore(stored(spark), filings, companies, figures)
    twice = replay.rescore(once, filings, companies, figures)
    see = lambda d: {r.order_id: (r.score, r.tier, r.firmness, r.quality_adj, r.p_stale, r.history_n) for r in d.collect()}
    got = see(once)
    assert got == see(twice) and set(got) == set("abde")
    assert got["a"][2:] == (1.0, 0.15, 0.7, 0) and got["b"][2:] == (0.6, 0.0, 1.0, 1)
    assert got["d"][1] == "STORE" and got["e"][0] <= 25


def test_recheck_and_apply(spark):
    cols = "ann_id string, is_order_like boolean, pdf_url string, headline string, body string, attachment string, subcategory string, company_name string, filed_at timestamp"
    won = "We have received a work order from Jal Nigam worth Rs 120 crore for supply of pumps, to be completed within 6 months."
    rows = [
        ("new", None, None, "Receipt of work order", won, None, None, "Own Ltd", AT), ("unread", None, "u", "Receipt of work order", won, None, None, "Own Ltd", AT), ("old", True, None, "Receipt of work order", won, None, None, "Own Ltd", AT),
        ("gone", True, None, "Board Meeting Intimation", "A meeting is called.", None, None, "Own Ltd", AT), ("never", None, None, "Board Meeting Intimation", "A meeting is called.", None, None, "Own Ltd", AT), ("empty", True, None, None, None, None, None, "Own Ltd", AT),
    ]
    orders = spark.createDataFrame([("old", 1.0, 3.0, "kept"), ("gone", 2.0, None, "lost"), ("other", 3.0, None, "stays")], "order_id string, order_value_inr double, execution_months double, note string")
    checked = replay.recheck(spark.createDataFrame(rows, cols), orders)
    assert {r.ann_id: r.outcome for r in checked.collect()} == {"new": "created", "unread": "needs_text", "old": "refreshed", "gone": "dropped"}
    after = {r.order_id: (r.order_value_inr, r.execution_months, r.note) for r in replay.apply_recheck(orders, checked).collect()}
    assert after == {"old": (120e7, 6.0, "kept"), "other": (3.0, None, "stays"), "new": (120e7, 6.0, None)}


def test_near_values_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(k, k % 3, rnd.choice([0.0, 0.5, 150.0, 199.0, 200.0, 201.0, 1e7, 1e9]) * (1 + rnd.choice([0, 0.004, 0.005, 0.0051, -0.005])), AT + timedelta(seconds=rnd.randrange(9 * 86400))) for k in range(400)]
    rows += [(1000, 0, None, AT), (1001, None, 1e7, AT), (1002, 0, -5.0, AT), (1003, 0, -5.5, AT), (1004, 1, 1e9, AT), (1005, 1, 1e9, AT + timedelta(3))]
    got = {tuple(r) for r in views.near_duplicates(spark.createDataFrame(rows, "order_id long, company_id int, order_value_inr double, filed_at timestamp"), 0.005, 3).collect()}
    want = set()
    for a, c, v, t in rows:
        like = [b for b, d, w, u in rows if b != a and c is not None and d == c and None not in (v, w) and abs(v - w) <= max(1.0, 0.005 * v) and abs((t - u).total_seconds()) <= 3 * 86400]
        want |= {(a, min(like))} if like else set()
    assert got == want and len(got) > 100


def test_years_against_brute_force(spark):
    rnd = random.Random(6)
    left = [(k, rnd.choice("abz") if k else None, rnd.choice([None, *range(2000, 2010)])) for k in range(120)]
    right = [(rnd.choice("abc"), rnd.choice([None, *range(2001, 2012, 3)]), float(rnd.randrange(9))) for _ in range(30)] + [(None, 2003, 1.0), ("a", 2004, None)]
    d = views.as_of(spark.createDataFrame(left, "n int, key string, want int"), spark.createDataFrame(right, "key string, fy int, v double"), "key", F.col("want"), "fy", ["v"])
    got = {r.n: (r.fy, r.v) for r in d.collect()}
    for n, key, want in left:
        fit = [(y, -1.0 if v is None else v) for k, y, v in right if key and k == key and y is not None and want is not None and y <= want]
        y, v = max(fit, default=(None, None))
        assert got[n] == (y, None if v == -1.0 else v)
    assert len(got) == 120


def test_messages_with_notes_and_links(spark):
    o = stored(spark).filter("order_id = 'a'").withColumns({"extraction_notes": F.lit("+0.12 o&m; order evidence: states a <b> receipt; second; third"), "pdf_url": F.lit("https://example.invalid/a?b&c"), "symbol": F.lit("SYM")})
    lines = pages.message(scoring.score(o), "https://example.invalid/{key}/").first().message.split("\n")
    assert "? states a &lt;b&gt; receipt" in lines and "? second" in lines and "? third" not in lines
    assert "• revenue unknown, so the score stops at its cap" in lines
    assert lines[-1] == '<a href="https://example.invalid/a?b&amp;c">filing</a> <a href="https://example.invalid/SYM/">company</a>'


def test_backfill_days(spark):
    f = spark.createDataFrame([(k, AT - timedelta(hours=h), k % 2 == 0) for k, h in enumerate([0, 1, 24, 25, 48, 49, 73])], "n int, filed_at timestamp, is_order_like boolean")
    got = sorted((r.day, r.announcements, r.order_like) for r in replay.day_totals(replay.by_days(f, F.lit(AT), 3)).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 1, 0)]


def test_functions_by_sql_name(spark):
    filing.register(spark)
    said = "We have received a work order from Jal Nigam for design and supply of water pumps. Our order book stands at Rs 450 crore."
    r = spark.createDataFrame([(said,)], "said string").selectExpr("find_order_books(said, DATE '2026-01-31', 'update')[0].value_inr AS book", "order_scope(NULL, said, NULL).phrase AS scope", "receipt_statement(said) AS receipt").first()
    assert (r.book, r.scope) == (450e7, "design and supply of water pumps") and r.receipt.startswith("received a work order")
