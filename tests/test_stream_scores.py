"""Scores inside a stream equal those of a batch over all that came."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import sequences
from tidemark.streaming import history

SCHEMA = "order_id long, company_id string, filed_at timestamp, seen_at timestamp, order_value_inr double, execution_months double, firmness double, quality_adj double, is_amendment boolean, is_related_party boolean, extraction_conf double"


def filings():
    day = lambda d: datetime(2021, 1, 1) + timedelta(days=d)
    out = []
    for k in range(9):
        c = "ABA"[k % 3]
        at = day(k * 130)  # the window of 720 days moves past the first ones
        out.append((k, c, at, at + timedelta(hours=1), None if k == 4 else 1e8 * (k + 1), 12.0, 0.8, 0.1, k == 3, False, 0.9))
    return out


def test_single_filings_in_a_stream_score_as_the_batch(spark, tmp_path):
    companies = spark.createDataFrame([("A", False, 5e9), ("B", True, 2e9)], "company_id string, is_sme boolean, market_cap_inr double")
    figures = spark.createDataFrame([("A", 4e8, 1.5e9, 0.2)], "company_id string, q_revenue_inr double, ttm_revenue_inr double, ebitda_margin double")
    at = str(tmp_path / "orders")
    # one file a filing, in their order; the last but one comes twice, as after a batch that was run again
    for row in [*filings(), filings()[7]]:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for _ in range(2):  # started again, it has nothing left to do
        history.start(stream, companies, figures, str(tmp_path / "scored"), str(tmp_path / "log")).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    told = ["order_id", "history_median", "history_n", "score", "tier"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "scored")).select(told).collect()))
    d = spark.createDataFrame(filings(), SCHEMA).join(companies, "company_id", "left").join(figures, "company_id", "left")
    want = sorted(map(tuple, scoring.score(sequences.novelty_history(d)).select(told).collect()))
    assert got == want and len(got) == 9
    assert {r[2] for r in got} >= {0, 1, 2}


def test_filings_of_one_batch_know_those_before_them(spark, tmp_path):
    at = str(tmp_path / "orders")
    spark.createDataFrame(filings(), SCHEMA).coalesce(1).write.parquet(at)
    stream = spark.readStream.schema(SCHEMA).parquet(at)
    with history.settings(spark, history.STORE):
        history.with_history(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = {r.order_id: (r.history_median, r.history_n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.order_id: (r.history_median, r.history_n) for r in sequences.novelty_history(spark.createDataFrame(filings(), SCHEMA)).collect()}
    assert got == want
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("history_n") > 0).count() > 0
