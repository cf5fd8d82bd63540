"""Micro-batch ingest (R1-R12, K3-K5, K8). Batch and stream share every transformation.

The checkpoint is the high-water mark: a restarted stream reads what it has not. A filing is stored once (its id is the
key); a late one is stored too and only marked late. Alerts go out once for each order and channel.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scan
from ..operators import sequences, views
from ..shared import cut, exists
from ..sources import landed


def counters() -> list[Column]:
    """Counters of classified filings."""
    return [F.count("*").alias("fetched"), F.count_if("is_order_like").alias("orders"), F.count_if("is_amendment").alias("amendments"), F.count_if("late").alias("late"), F.max("filed_at").alias("window_to")]


def silver(filings: DataFrame, seen_at) -> DataFrame:
    """Keyed, classified filings; one scan of each text for all word lists."""
    f = landed.keyed(filings)
    lead = F.substring(F.concat_ws(" ", "headline", "body"), 1, 400)
    f = f.withColumns({"__said": scan.order_marks(F.concat_ws(" ", "headline", "body")), "__title": F.concat_ws(" ", "headline", "subcategory")}).withColumns({"__lead": scan.word_marks(lead), "__marks": scan.order_marks("__title")})
    order = (F.col("targeted") | scan.looks_like_order("__said")) & scan.non_order("__marks", "__title").isNull()
    late = F.unix_seconds(seen_at) - F.unix_seconds("filed_at") > 48 * 3600
    return f.withColumns({"is_order_like": F.coalesce(order, F.lit(False)), "is_amendment": scan.has("__lead", "amendment"), "seen_at": seen_at, "late": F.coalesce(late, F.lit(False))}).drop("__said", "__title", "__lead", "__marks")


def append_new(batch: DataFrame, table: str, key: str = "ann_id", *, number: int | str | None = None, watch: Observation | None = None, tasks: int | None = None) -> DataFrame:
    """The rows of a batch whose key the table does not hold, appended to it; returned as written.

    Of rows of one key the earliest stays, then the one of the first venue. With its `number` a batch owns one folder: when it
    is run again, keys of that folder do not count as held and the folder is written anew, so a replay hands over what the
    first run did. `watch` gets `stored` from the write itself. Where the size of a batch is known, `tasks` says in how many it
    is sorted and written; else the session's number of partitions holds, whatever the rows.
    """
    spark = batch.sparkSession
    first = W.partitionBy(key).orderBy(*[c for c in ("filed_at", "exchange") if c in batch.columns], F.xxhash64(*batch.columns))
    dealt = batch.repartition(tasks, key) if tasks else batch
    fresh = dealt.withColumn("__turn", F.row_number().over(first)).filter("__turn = 1").drop("__turn")
    name = uuid.uuid4().hex if number is None else str(number)
    if exists(spark, table):
        old = spark.read.option("basePath", table).parquet(table)
        fresh = fresh.join(old.filter(F.col("batch").cast("string") != name).select(key), key, "left_anti")
    fresh = fresh.observe(watch, F.count("*").alias("stored")) if watch else fresh
    at = f"{table}/batch={name}"
    fresh.write.mode("overwrite").parquet(at)
    return spark.read.schema(fresh.schema).parquet(at)


#: What a run tells of each venue.
RUN = "feed string, failed boolean, error string, fetched long, orders long, amendments long, late long, window_to timestamp, stored long"


def run(feeds: dict[str, Callable[[], DataFrame]], table: str, seen_at, *, number: int | None = None, tasks: dict[str, Callable[[], int]] | None = None) -> DataFrame:
    """One run over the landed filings of each venue; a venue that cannot be read is a flag and stops no other.

    The counters are observed in the write of a venue's rows, so nothing is read a second time for them. A failed venue has
    none: what it had got so far is not in the table, for its folder was never finished. `tasks` are those of `append_new`, by venue.
    """
    out, spark = [], None
    for feed, landed_rows in feeds.items():
        seen, kept = Observation(), Observation()
        try:
            rows = landed_rows()
            spark = rows.sparkSession
            rows = silver(rows, seen_at).observe(seen, *counters())
            append_new(rows, table, number=None if number is None else f"{number}-{feed}", watch=kept, tasks=tasks[feed]() if tasks and feed in tasks else None)
            got = {**seen.get, **kept.get}
            out.append((feed, False, None, *(got[c] for c in ("fetched", "orders", "amendments", "late", "window_to", "stored"))))
        except (PySparkException, Py4JJavaError) as e:  # what reading or writing this venue's rows may raise
            said = str(e.java_exception.getMessage()) if isinstance(e, Py4JJavaError) else str(e)
            out.append((feed, True, said.split("\n")[0][:500], *[None] * 6))
    return (spark or SparkSession.active()).createDataFrame(out, RUN)


def start(filings: DataFrame, table: str, checkpoint: str, *, then: Callable[[DataFrame], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Runs until all landed files are in (or each `every`); `then` gets each batch's new rows.

    A batch that failed anywhere, in `then` too, is run again with its number and hands the same rows over.
    """

    def batch(df: DataFrame, number: int) -> None:
        new = append_new(silver(df, F.current_timestamp()), table, number=number)
        if then:
            then(new)

    w = filings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def backfill(filings: DataFrame, table: str, seen_at) -> DataFrame:
    """The same over a batch, alerts left out; running it again stores nothing."""
    return append_new(silver(filings, seen_at), table)


def alert_once(orders: DataFrame, log: str, channel: str, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Orders not yet sent on a channel are sent and logged; only a success silences an order.

    An outbox: what is due is written as attempts before it is sent, and what `send` reports as settled after it, under one
    batch name. A run that ended between both leaves attempts without a word: the next one settles them as uncertain (`ok`
    null) and does not send them again, for they may have gone out. To send such an order again, its row is taken out of the log.
    """
    spark = orders.sparkSession
    attempts, settled = f"{log}/attempts", f"{log}/settled"
    due = orders.withColumn("channel", F.lit(channel))
    if exists(spark, attempts):
        tried = spark.read.option("basePath", attempts).parquet(f"{attempts}/batch=*").select("order_id", "channel", F.col("batch").cast("string").alias("batch"))
        if exists(spark, settled):
            done = spark.read.option("basePath", settled).parquet(f"{settled}/batch=*")
            tried = tried.join(done.select(F.col("batch").cast("string").alias("batch")).distinct(), "batch", "left_anti")
        for r in tried.select("batch").distinct().collect():  # runs that broke off, one name each
            lost = tried.filter(F.col("batch") == r.batch).select("order_id", "channel", F.lit(None).cast("boolean").alias("ok"), F.current_timestamp().alias("sent_at"))
            cut(lost, "lost").write.mode("overwrite").parquet(f"{settled}/batch={r.batch}")
    if exists(spark, settled):
        silent = spark.read.option("basePath", settled).parquet(f"{settled}/batch=*").filter("ok OR ok IS NULL").select("order_id", "channel")
        due = due.join(silent, ["order_id", "channel"], "left_anti")
    name = f"b{uuid.uuid4().hex}"
    due.write.parquet(f"{attempts}/batch={name}")
    out = send(spark.read.schema(due.schema).parquet(f"{attempts}/batch={name}")).select("order_id", "channel", "ok", F.current_timestamp().alias("sent_at"))
    out.write.parquet(f"{settled}/batch={name}")
    return spark.read.schema(out.schema).parquet(f"{settled}/batch={name}")


def to_files(path: str) -> Callable[[DataFrame], DataFrame]:
    """K5: a sink that lands messages as JSON for a sender to pick up."""

    def send(due: DataFrame) -> DataFrame:
        due.write.mode("append").json(path)
        return due.withColumn("ok", F.lit(True))

    return send


def run_metrics(batch: DataFrame) -> DataFrame:
    """The counters of one run, of rows that are stored already."""
    return batch.agg(*counters())


def event_windows(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """An extension: tumbling counts with a watermark, for a stream or a batch."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def stream_of(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def feed_warnings(runs: DataFrame, hours: int = 24) -> DataFrame:
    """Of the runs that end three failures, those to warn about: one for each feed and span of hours."""
    alarms = sequences.feed_alarm(runs)
    g = sequences.greedy_groups(alarms, ["feed"], F.unix_seconds("at"), hours * 3600, ["run_id"])
    return g.groupBy("feed", "anchor").agg(F.min_by("run_id", F.struct("d", "run_id")).alias("run_id")).select("feed", "run_id")


def to_alert(orders: DataFrame) -> DataFrame:
    """Orders whose like (half a percent, three days) has a smaller id are left to that one."""
    twin = views.near_duplicates(orders, 0.005, 3).filter(F.col("duplicate_of") < F.col("order_id")).select("order_id")
    return orders.filter(F.col("tier").isin("HIGH", "MEDIUM")).join(twin, "order_id", "left_anti")
