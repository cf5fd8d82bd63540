"""Runs with a broken venue, and alerts across a run that breaks off."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import landed
from tidemark.streaming import ingest

from .test_engine import FEED


def test_a_broken_venue_is_a_flag_and_stops_no_other(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "0.json").write_text("\n".join(map(json.dumps, FEED)))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "0.parquet").write_bytes(b"PAR1 this is no table PAR1")
    table = str(tmp_path / "table")
    good = lambda: landed.bse(landed.read_json(spark, str(tmp_path / "good"), "BSE"))
    bad = lambda: spark.read.schema(good().schema).parquet(str(tmp_path / "bad"))
    gone = lambda: spark.read.json(str(tmp_path / "nowhere"))
    said = {r.feed: r for r in ingest.run({"bad": bad, "good": good, "gone": gone}, table, F.current_timestamp(), number=4).collect()}
    assert [said[f].failed for f in ("good", "bad", "gone")] == [False, True, True] and said["gone"].error and said["bad"].fetched is None
    again = ingest.run_metrics(ingest.silver(good(), F.current_timestamp())).first()
    assert [said["good"][c] for c in ("fetched", "orders", "amendments", "late", "window_to")] == [again[c] for c in ("fetched", "orders", "amendments", "late", "window_to")]
    assert said["good"].stored == spark.read.parquet(table).count() == 3
    # once more: all is held already
    assert ingest.run({"good": good}, table, F.current_timestamp(), number=5).first().stored == 0
    # and the same run again hands over the same rows
    assert ingest.run({"good": good}, table, F.current_timestamp(), number=4).first().stored == 3


def test_of_rows_of_one_key_the_earliest_stays(spark, tmp_path):
    d = spark.createDataFrame([("a", "BSE", 3), ("a", "NSE", 2), ("a", "BSE", 2), ("b", "NSE", 1)], "ann_id string, exchange string, filed_at int").repartition(3)
    assert sorted(map(tuple, ingest.append_new(d, str(tmp_path / "t")).select("ann_id", "exchange", "filed_at").collect())) == [("a", "BSE", 2), ("b", "NSE", 1)]


def test_a_run_that_ends_between_send_and_log_leaves_uncertain_alerts(spark, tmp_path):
    orders = spark.createDataFrame([("a", "x"), ("b", "y")], "order_id string, message string")
    sent, log = [], str(tmp_path / "log")

    def send(due):
        sent.extend(r.order_id for r in due.collect())
        return due.withColumn("ok", F.lit(True))

    def send_and_die(due):
        send(due)
        raise RuntimeError("the driver is gone")

    with pytest.raises(RuntimeError):
        ingest.alert_once(orders, log, "chat", send_and_die)
    more = orders.unionByName(spark.createDataFrame([("c", "z")], orders.schema))
    assert [r.order_id for r in ingest.alert_once(more, log, "chat", send).collect()] == ["c"]
    assert sorted(sent) == ["a", "b", "c"]
    told = {r.order_id: r.ok for r in spark.read.parquet(f"{log}/settled").collect()}
    assert told == {"a": None, "b": None, "c": True}
    assert ingest.alert_once(more, log, "chat", send).count() == 0 and ingest.alert_once(more, log, "mail", send).count() == 3
