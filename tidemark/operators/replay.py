"""Work over what is stored already (R8-R10, R12, J2-J4, J6, K9): nothing here fetches or sends anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import filing, scan, scoring
from ..shared import cut
from . import sequences

#: What a company's stored row and its figures give to a score.
COMPANY, FIGURES = ("is_sme", "market_cap_inr"), ("q_revenue_inr", "ttm_revenue_inr", "ebitda_margin")


def firmness_of(kind: Column) -> Column:
    """The firmness of a stored kind of order: of its phrase; 0.5 for an unknown one, none for an amendment."""
    by = F.create_map(*[F.lit(x) for share, words in D.FIRMNESS.items() for w in words for x in (w, share)])
    return F.when(kind == "amendment", 0.0).otherwise(F.coalesce(F.try_element_at(by, kind), F.lit(0.5)))


def rescore(orders: DataFrame, filings: DataFrame, companies: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Every stored order (order_id, company_id, filed_at, order_value_inr, ..., breakdown) scored by the rules of today.

    Staleness is measured to when the filing was first seen (`filings`: ann_id, seen_at), so a rescore ages nothing. Firmness and
    the adjustment by words are those of the stored breakdown; without one, firmness goes by the kind of order. Scoring the result
    again changes nothing. An order without company, figures or filing stays and is scored without them.
    """
    gone = (*COMPANY, *FIGURES, "seen_at", "firmness", "quality_adj", "history_median", "history_n")
    d = orders.drop(*[c for c in gone if c in orders.columns])
    d = d.join(filings.select(F.col("ann_id").alias("order_id"), "seen_at"), "order_id", "left")
    d = d.join(companies.select("company_id", *COMPANY), "company_id", "left").join(fundamentals.select("company_id", *FIGURES), "company_id", "left")
    d = d.withColumns({"firmness": F.coalesce(scoring.read_back("breakdown", "components.firmness.firmness"), firmness_of(F.coalesce("order_type", F.lit("unknown")))), "quality_adj": F.coalesce(scoring.read_back("breakdown", "components.margin_quality.keyword_adj"), F.lit(0.0))})
    return scoring.with_breakdown(scoring.score(sequences.novelty_history(d)))


def recheck(filings: DataFrame, orders: DataFrame) -> DataFrame:
    """Each stored order-like filing (ann_id, is_order_like, pdf_url and the columns of `filing.extract`) read again.

    `outcome` is dropped (a stored order that is none any more), refreshed, created, needs_text (a new order whose attachment was
    never read, so its figure is not there) or none; `old_value_inr` and `old_months` are what the stored order holds.
    """
    filings = filings.withColumn("__said", scan.order_marks(F.concat_ws(" ", "headline", "body", "subcategory")))
    like = F.coalesce("is_order_like", F.lit(False)) | scan.looks_like_order("__said")
    says = F.concat_ws("", "headline", "body", "attachment") != ""
    held = orders.select(F.col("order_id").alias("ann_id"), F.col("order_value_inr").alias("old_value_inr"), F.col("execution_months").alias("old_months"), F.lit(True).alias("__held"))
    d = filing.extract(filings.filter(like & says).drop("__said")).join(held, "ann_id", "left")
    is_held, unread = F.coalesce("__held", F.lit(False)), F.coalesce("attachment", F.lit("")).eqNullSafe("") & F.col("pdf_url").isNotNull()
    what = F.when(is_held, F.when(F.col("is_order"), "refreshed").otherwise("dropped")).when(~F.col("is_order"), "none").when(unread, "needs_text").otherwise("created")
    return d.withColumn("outcome", what).drop("__held")


def apply_recheck(orders: DataFrame, checked: DataFrame) -> DataFrame:
    """The stored orders after a recheck: dropped ones go, refreshed ones take what was read, created ones are added.

    A refreshed order keeps the columns that no reading has; a column that was read stands even where it is null now.
    """
    ids = checked.filter("outcome IN ('dropped', 'refreshed')").select(F.col("ann_id").alias("order_id"))
    new = checked.filter("outcome IN ('refreshed', 'created')").withColumnRenamed("ann_id", "order_id")
    read = [c for c in orders.columns if c in new.columns]
    kept = orders.select("order_id", *[c for c in orders.columns if c not in read])
    return orders.join(ids, "order_id", "left_anti").unionByName(new.select(*read).join(kept, "order_id", "left"), allowMissingColumns=True)


def resummarise(orders: DataFrame, filings: DataFrame) -> DataFrame:
    """Scope and summary of each stored order from its filing's texts; all else stays. A summary a model wrote is kept."""
    texts = filings.select(F.col("ann_id").alias("order_id"), "headline", "body", "attachment")
    old = orders.withColumnRenamed("summary", "__old").drop("scope", "headline", "body", "attachment")
    d = filing.describe(old.join(texts, "order_id", "left"))
    keep = F.contains(F.coalesce("extraction_method", F.lit("")), F.lit("llm")) & (F.coalesce("__old", F.lit("")) != "")
    return d.withColumn("summary", F.when(keep, F.col("__old")).otherwise(F.col("summary"))).select(*orders.columns)


def order_documents(orders: DataFrame, filings: DataFrame) -> DataFrame:
    """The distinct attachments of filings that gave an order, with their company."""
    return orders.select(F.col("order_id").alias("ann_id")).join(filings.filter(F.col("pdf_url").isNotNull()).select("ann_id", "company_name", "pdf_url"), "ann_id").select("company_name", "pdf_url").distinct()


def work_left(items: DataFrame, ledger: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Items not done yet: none of their tries (key, ok) went well, and fewer than `most` failed."""
    tried = ledger.groupBy(key).agg(F.max("ok").alias("__ok"), F.count_if(~F.col("ok")).alias("__failed"))
    return items.join(tried.filter(F.col("__ok") | (F.col("__failed") >= most)).select(key), key, "left_anti")


def frozen(companies: DataFrame) -> DataFrame:
    """The tracked companies as they are when a run begins; what the run itself adds shows in the next one."""
    return cut(companies.select("company_id").distinct(), "tracked")


def of_tracked(batch: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Filings of tracked companies."""
    return batch.join(snapshot, "company_id", "left_semi")


def by_days(filings: DataFrame, to: Column, days: int) -> DataFrame:
    """Filings of the days before `to`, each with `day`, the number of its span of 24 hours: 1 is the last; the first moment of a span counts to it."""
    back = F.unix_micros(to) - F.unix_micros("filed_at")
    return filings.withColumn("day", F.ceil(back / 86_400_000_000).cast("int")).filter(F.col("day").between(1, days))


def day_totals(stored: DataFrame) -> DataFrame:
    """The counters of a backfill, day by day."""
    return stored.groupBy("day").agg(F.count("*").alias("announcements"), F.count_if("is_order_like").alias("order_like"), F.max("filed_at").alias("last_filed_at"))
