"""Scores inside a stream: each company's order history is state."""

from __future__ import annotations

import statistics
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import scoring
from ..shared import settings

#: State that lives longer than an executor's memory, with a time to live; and no batches without data, of which a state with
#: a time to live would otherwise run one after the other, so that a run over what has landed never ended.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class OrderHistory(StatefulProcessor):
    """A company's orders of the last `days`, as a list of (order, time, value); gives each new one the median and number of those before it.

    A value that does not count (an amendment, none, or not above 0) is remembered only so that its order is not told twice:
    an order that comes again, as it does when the stream that wrote it runs a batch again, is dropped. Entries live for
    `days` from their arrival, which is never before the filing's own time, so none goes while it still counts.
    """

    def __init__(self, days: int):
        self.span = days * 86400

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "id string, at long, value double", self.span * 1000)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        past = list(self.past.get()) if self.past.exists() else []
        seen = {p[0] for p in past}
        new = pd.concat(list(rows))
        new.columns = [*new.columns[:-3], "__id", "__at", "__value"]  # the last three come without their names
        new = new.sort_values(["__at", "__id"], kind="stable")
        new = new[~new["__id"].isin(seen)].drop_duplicates("__id")
        fresh = [(i, int(a), None if v != v else float(v)) for i, a, v in zip(new["__id"], new["__at"], new["__value"].astype("float64"))]
        values = [(p[1], p[2]) for p in (*past, *fresh) if p[2] is not None]
        median, count = [], []
        for _, at, _ in fresh:
            h = [v for t, v in values if at - self.span <= t < at]
            median.append(statistics.median(h) if h else None)
            count.append(len(h))
        if fresh:
            self.past.appendList(fresh)
            yield new.drop(columns=["__id", "__at", "__value"]).assign(history_median=pd.array(median, "Float64"), history_n=count)

    def close(self) -> None:
        pass


def with_history(orders: DataFrame, days: int = 720) -> DataFrame:
    """A stream of orders with history_median and history_n, as `sequences.novelty_history` has them for what has come by then."""
    counted = (F.col("order_value_inr") > 0) & ~F.coalesce("is_amendment", F.lit(False))
    d = orders.withColumns({"__id": F.col("order_id").cast("string"), "__at": F.unix_seconds("filed_at"), "__value": F.when(counted, F.col("order_value_inr"))}).filter("__at IS NOT NULL")
    schema = T.StructType([*orders.schema.fields, T.StructField("history_median", T.DoubleType()), T.StructField("history_n", T.LongType())])
    return d.groupBy("company_id").transformWithStateInPandas(OrderHistory(days), schema, "Append", "ProcessingTime")


def scored(orders: DataFrame, companies: DataFrame, fundamentals: DataFrame, days: int = 720) -> DataFrame:
    """A stream of extracted orders, scored: what a company's row and figures say when a batch comes, and its history as state."""
    d = orders.join(companies.select("company_id", "is_sme", "market_cap_inr"), "company_id", "left").join(fundamentals.select("company_id", "q_revenue_inr", "ttm_revenue_inr", "ebitda_margin"), "company_id", "left")
    return scoring.score(with_history(d, days))


def start(orders: DataFrame, companies: DataFrame, fundamentals: DataFrame, table: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Scores each batch of a stream of orders into `table`, for all that has landed or each `every`. The sink's log and the state's go by batch, so each order is scored once."""
    with settings(orders.sparkSession, STORE):
        w = scored(orders, companies, fundamentals).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
