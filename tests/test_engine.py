"""Queries against their SQL in DuckDB, invariants of the score, stream against batch."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import scoring
from tidemark.operators import entity, sequences
from tidemark.plans import base, catalogue, scored
from tidemark.sources import landed
from tidemark.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def shown(v):
    if isinstance(v, (list, tuple)):
        return [shown(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(([shown(r[c]) for c in cols] for r in df.collect()), key=str)
    r = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(([shown(x[names.index(c)]) for c in cols] for x in r.fetchall()), key=str)
    assert got == want


def test_messages_of_all_alerts(spark, duck, sf):
    got = {r.order_id: r.message.split("\n") for r in catalogue.QUERIES["alert_messages_all"](spark, sf).collect()}
    z = duck.execute(scored._SCORED + "SELECT order_id, company_id, order_value_inr, filed_at, tier FROM z").fetchall()
    by = {}
    for order, company, value, at, _ in z:
        by.setdefault(company, []).append((order, value, at))
    twin = lambda o, c, v, at: any(p < o and abs(w - v) <= max(1.0, 0.005 * v) and abs((b - at).total_seconds()) <= 3 * 86400 for p, w, b in by[c])
    want = {o for o, c, v, at, tier in z if tier in ("HIGH", "MEDIUM") and not twin(o, c, v, at)}
    assert set(got) == want and len(got) > 100
    assert all(x[0].startswith("<b>") and x[0].split("</b> ")[1].split(" ")[0] in ("HIGH", "MEDIUM") and x[1].startswith("Rs ") and len(x) >= 5 for x in got.values())


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())


GRID = dict(order_value_inr=5e8, execution_months=12.0, firmness=1.0, ebitda_margin=0.15, history_n=0, q_revenue_inr=1e9, ttm_revenue_inr=4e9, extraction_conf=0.8)


def scores(spark, *rows):
    kinds = scoring.INPUTS
    full = [tuple({k: None for k in kinds} | GRID | r for _ in "x")[0] for r in rows]
    df = spark.createDataFrame([tuple(f[k] for k in kinds) for f in full], ", ".join(f"{k} {v}" for k, v in kinds.items())).withColumn("k", F.monotonically_increasing_id())
    return [(r.score, r.tier) for r in scoring.score(df).orderBy("k").collect()]


def test_score_rises_with_value(spark):
    got = [s for s, _ in scores(spark, *[{"order_value_inr": v} for v in (2e7, 5e7, 1e8, 3e8, 6e8, 1e9, 2e9)])]
    assert got == sorted(got) and got[0] < got[-1]


def test_score_invariants(spark):
    r = scores(spark, {}, {"firmness": 0.3}, {"is_amendment": True}, {"order_value_inr": None}, {"q_revenue_inr": None, "ttm_revenue_inr": None}, {"order_value_inr": 5e10}, {"is_related_party": True}, {"market_cap_inr": 5e7}, {"order_value_inr": 9e6}, {"guidance_points": 90.0})
    plain, mou, amended, no_value, no_revenue, absurd, related, pump, tiny, guided = r
    assert mou[0] < plain[0] and amended[0] <= 25 and no_value[0] <= 35 and no_revenue[0] <= 60 and absurd[0] <= 40
    assert related[0] < plain[0] and pump[0] < plain[0] and tiny[1] == "STORE" and guided[1] == "HIGH"
    assert plain[1] in ("MEDIUM", "HIGH")


def test_guidance_points(spark):
    items = F.array(F.struct(F.lit(2027).alias("fy_end"), F.lit("revenue").alias("metric"), F.lit("total income").alias("label"), F.lit(105e7).alias("low_inr"), F.lit(None).cast("double").alias("growth_low")), F.struct(F.lit(2027).alias("fy_end"), F.lit("pat").alias("metric"), F.lit("pat").alias("label"), F.lit(5e7).alias("low_inr"), F.lit(None).cast("double").alias("growth_low")))
    last = [F.lit(2026), F.lit(32e7), F.lit(0.97e7), F.lit(0.54e7), F.lit(None).cast("double")]
    r = spark.range(1).select(scoring.guidance_points(items, F.lit(2027), *last).alias("g"), scoring.guidance_points(F.slice(items, 1, 0), F.lit(2027), *last).alias("none")).first()
    assert r.g.points == 100 and not r.g.implausible and r.none is None


def test_collapse_again_changes_nothing(spark, sf):
    f = base.filings(spark, sf).withColumn("score", F.col("firmness")).filter("company_id % 10 = 0")
    once = sequences.collapse(f)
    again = sequences.collapse(f.join(once.select("order_id"), "order_id", "left_semi"))
    key = lambda df: sorted((r.company_id, r.order_id) for r in df.collect())
    assert key(once) == key(again)


def test_collapse_covers_every_filing(spark, sf):
    n, again, companies = spark.read.parquet(f"{sf}/orders.parquet").agg(F.count("*"), F.count_if(F.col("o_orderkey") % 3 == 0), F.count_distinct("o_custkey")).first()
    r = catalogue.QUERIES["collapse_exchanges_all"](spark, sf).agg(F.sum("duplicate_filings"), F.count_distinct("company_id")).first()
    assert tuple(r) == (n + again, companies)


def test_collapse_of_companies_of_any_id(spark, tmp_path):
    day = lambda d: datetime(2020, 1, d)
    rows = [(3, 7, day(1), "O", 100.0, "1-URGENT"), (6, 7, day(1), "O", 100.0, "1-URGENT"), (9, 7, day(9), "O", 100.0, "1-URGENT"), (4, 5, day(1), "O", 5.0, "1-URGENT")] + [(1000 + k, 11, day(1 + k % 20), "O", float(k * 100 + 100), "2-HIGH") for k in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalogue.QUERIES["collapse_exchanges_all"](spark, str(tmp_path)).collect()
    assert sorted((r.order_id, r.duplicate_filings) for r in got if r.company_id == 7) == [(9, 2), (10_000_006, 4)]  # the latest of the filings with a value stays
    assert sum(r.duplicate_filings for r in got if r.company_id == 11) == 200 + sum((1000 + k) % 3 == 0 for k in range(200))


def test_company_ids_meet_across_venues(spark):
    f = spark.createDataFrame([("Beta Eng Limited", None, "BETA", None), ("BETA ENG LTD-$", None, None, "500001"), ("Gamma Works Ltd", "ine1", None, None), ("Gamma Works Private Limited", None, None, "7")], "company_name string, isin string, symbol string, bse_code string")
    known = spark.createDataFrame([("INE1", "Gamma Works", "ine1")], "company_id string, company_name string, isin string")
    got = {r.company_name: r.company_id for r in entity.resolve(f, known).collect()}
    assert got["Beta Eng Limited"] == got["BETA ENG LTD-$"] and got["Gamma Works Ltd"] == got["Gamma Works Private Limited"] == "INE1"


def test_company_ids_of_one_batch_close_over_isin_and_name(spark):
    rows = [("Xavier Works", "INE1", None, None), ("Yorke Works", "ine1 ", None, None), ("Yorke Works Ltd", None, None, "500"), ("Zenith Works", "INE9", "ZEN", None), ("Zenith Works Limited", "INE8", None, None), ("Alpine Works", "INE8", None, None), ("Solo", None, "SOLO", None), ("Solo", None, None, "7"), ("Known Works", "INE7", None, None), ("Other Works", "INE7", None, None), (None, None, None, None)]
    f = spark.createDataFrame(rows, "company_name string, isin string, symbol string, bse_code string")
    known = spark.createDataFrame([("K1", "KNOWN WORKS LTD", None)], "company_id string, company_name string, isin string")
    got = {(r.company_name, r.isin, r.symbol, r.bse_code): r.company_id for r in entity.resolve(f, known).collect()}
    ids = [got[r] for r in rows]
    assert ids[:6] == ["INE1"] * 3 + ["INE8"] * 3 and ids[6:8] == ["NSE:SOLO", "BSE:7"] and ids[8:10] == ["K1", "K1"] and ids[10].startswith("NAME:")


FEED = [
    {"NEWSID": "1", "SCRIP_CD": "500001", "SLONGNAME": "Alpha Ltd", "HEADLINE": "Award of <b>order</b> worth Rs 420.50 Cr", "News_submission_dt": "2026-10-01T10:00:00", "CATEGORYNAME": "Company Update", "targeted": False},
    {"NEWSID": "2", "SCRIP_CD": "500002", "SLONGNAME": "Beta Ltd", "HEADLINE": "Board Meeting Intimation", "News_submission_dt": "2026-10-01T11:00:00", "targeted": False},
    {"NEWSID": "1", "SCRIP_CD": "500001", "SLONGNAME": "Alpha Ltd", "HEADLINE": "Award of <b>order</b> worth Rs 420.50 Cr", "News_submission_dt": "2026-10-01T10:00:00", "targeted": True},
    {"NEWSID": "3", "SCRIP_CD": "500003", "SLONGNAME": "Gamma Ltd", "HEADLINE": "Cancellation of order of Rs 150 Cr", "News_submission_dt": "2026-10-01T12:00:00", "targeted": False},
]


def test_stream_equals_batch_and_stores_once(spark, tmp_path):
    import json

    for k in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in FEED[2 * k : 2 * k + 2]))
    table, seen = str(tmp_path / "silver"), []
    feed = landed.bse(landed.stream_json(spark, str(tmp_path / "in"), "BSE", files=1))
    run = lambda: ingest.start(feed, table, str(tmp_path / "checkpoint"), then=lambda df: seen.append(df.count())).awaitTermination()
    run()
    run()
    cols = ["ann_id", "headline", "is_order_like", "is_amendment"]
    streamed = sorted(map(tuple, spark.read.parquet(table).select(cols).collect()))
    batch = ingest.silver(landed.once(landed.bse(landed.read_json(spark, str(tmp_path / "in"), "BSE"))), F.current_timestamp())
    assert sum(seen) == 3 and streamed == sorted(map(tuple, batch.select(cols).collect()))
    assert ingest.backfill(landed.bse(landed.read_json(spark, str(tmp_path / "in"), "BSE")), table, F.current_timestamp()).count() == 0


def test_alerts_go_out_once(spark, tmp_path):
    orders = spark.createDataFrame([("a", "x"), ("b", "y")], "order_id string, message string")
    fails_b = lambda due: due.withColumn("ok", F.col("order_id") != "b")
    log = str(tmp_path / "log")
    assert ingest.alert_once(orders, log, "chat", fails_b).count() == 2
    assert [r.order_id for r in ingest.alert_once(orders, log, "chat", ingest.to_files(str(tmp_path / "out"))).collect()] == ["b"]
    assert ingest.alert_once(orders, log, "chat", fails_b).count() == 0


def test_a_batch_that_fails_after_its_write_is_handed_over_again(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps(r) for r in FEED))
    feed = landed.bse(landed.stream_json(spark, str(tmp_path / "in"), "BSE", files=1))
    log, turn = str(tmp_path / "log"), []

    def then(new):
        turn.append(new.count())
        if len(turn) == 1:
            raise RuntimeError("the sender is down")
        ingest.alert_once(new.select(F.col("ann_id").alias("order_id")), log, "chat", ingest.to_files(str(tmp_path / "sent")))

    for _ in range(3):
        try:
            ingest.start(feed, str(tmp_path / "silver"), str(tmp_path / "checkpoint"), then=then).awaitTermination()
        except Exception as e:
            assert "the sender is down" in str(e)
    assert turn == [3, 3] and spark.read.parquet(str(tmp_path / "silver")).count() == 3
    assert spark.read.json(str(tmp_path / "sent")).groupBy("order_id").count().filter("count = 1").count() == 3


def test_what_is_sent_is_worked_out_once(spark, tmp_path):
    import uuid

    seen = []
    orders = spark.createDataFrame([("a",)], "order_id string").withColumn("message", F.udf(lambda: uuid.uuid4().hex).asNondeterministic()())

    def send(due):
        seen.extend([due.first().message, due.first().message])
        return due.withColumn("ok", F.lit(True))

    ingest.alert_once(orders, str(tmp_path / "log"), "chat", send)
    assert seen[0] == seen[1]


def test_windows_over_a_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    s = ingest.event_windows(ingest.stream_of(spark, str(tmp_path / "e"), e.schema))
    q = s.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, ingest.event_windows(e).collect()))
