"""No step of a venue's run sorts more rows in a task when its table grows."""

import re

from pyspark.sql import functions as F

from tidemark.plans import ingests
from tidemark.shared import settings


def test_a_run_is_sorted_in_tasks_by_rows(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(ingests, "SORTED", 100, raising=False)
    monkeypatch.setattr(ingests, "shared_dir", lambda _: str(tmp_path))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rows = orders.count()
    with settings(spark, {"spark.sql.shuffle.partitions": "2"}):
        said = {r.feed: r for r in ingests.venue_runs(spark, sf).collect()}
    assert said["bse"].stored == said["bse"].fetched == rows and said["gone"].failed
    stored = spark.read.parquet(*map(str, tmp_path.glob("runs-*")))
    assert stored.count() == stored.select("native_id").distinct().count() == rows
    by_task = stored.groupBy(F.input_file_name()).count().toPandas()["count"]
    assert len(by_task) == -(-rows // 100) and max(by_task) <= 200


def test_rows_are_dealt_out_once_for_each_sort(spark, sf, capsys):
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        ingests.feed_normalised(spark, sf).explain()
    dealt = re.findall(r"Exchange (\w+).*(REPARTITION_BY_NUM|ENSURE_REQUIREMENTS)", capsys.readouterr().out)
    assert dealt and set(dealt) == {("hashpartitioning", "REPARTITION_BY_NUM")}


def test_a_venue_whose_size_cannot_be_told_is_a_flag(spark, tmp_path):
    r = ingests.venue_runs(spark, str(tmp_path / "nowhere")).collect()
    assert [(x.feed, x.failed) for x in r] == [("bse", True), ("gone", True)]
