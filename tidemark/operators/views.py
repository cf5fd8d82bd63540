"""Relational views over filings, orders and companies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dictionaries as D
from .windows import last_before


def orders_view(orders: DataFrame, companies: DataFrame, *, name: str | None = None, tier: str | None = None, exchange: str | None = None, since: Column | None = None, min_score: float | None = None, min_ratio: float | None = None, amendments: bool = False, has_value: bool = False, limit: int = 5000) -> DataFrame:
    """Filtered orders with their company, newest first. `since` is a date; its whole day counts (TR4)."""
    tests = [
        F.to_date("filed_at") >= since if since is not None else None,
        F.col("company_name").ilike(f"%{name}%") if name else None,
        F.col("tier") == tier if tier else None,
        F.col("exchange") == exchange if exchange else None,
        F.col("score") >= min_score if min_score is not None else None,
        F.col("ratio_quarter") >= min_ratio if min_ratio is not None else None,
        None if amendments else ~F.coalesce("is_amendment", F.lit(False)),
        F.col("order_value_inr").isNotNull() if has_value else None,
    ]
    out = orders.join(companies, "company_id", "left")
    for t in tests:
        out = out if t is None else out.filter(t)
    return out.orderBy(F.desc("filed_at"), "order_id").limit(limit)


def page(df: DataFrame, column: str, *, descending: bool, size: int, number: int, tie: str) -> DataFrame:
    """One page of a sort with nulls last either way."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie).offset(size * number).limit(size)


def tier_stats(orders: DataFrame) -> DataFrame:
    """A2, A9."""
    return orders.agg(F.count("*").alias("orders"), *[F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("HIGH", "MEDIUM", "WATCH", "STORE")], F.count("order_value_inr").alias("valued"), F.count_distinct("company_id").alias("companies"))


def top_companies(orders: DataFrame, value: str, n: int = 15) -> DataFrame:
    """A1, L2."""
    g = orders.groupBy("company_id").agg(F.count("*").alias("n"), F.sum(value).alias("v"), F.max_by("company_name", "order_id").alias("company_name"))
    return g.orderBy(F.desc("v"), "company_id").limit(n)


def wins(orders: DataFrame, since: Column) -> DataFrame:
    """Of each company its orders from a day on: how many, their value, amendments among them, the newest."""
    return orders.filter(F.to_date("filed_at") >= since).groupBy("company_id").agg(F.count("*").alias("wins"), F.sum("order_value_inr").alias("wins_inr"), F.count_if("is_amendment").alias("amendments"), F.max("filed_at").alias("newest"))


def kinds(candidates: DataFrame) -> DataFrame:
    """How many candidates there are of each kind of document."""
    return candidates.groupBy("kind").agg(F.count("*").alias("n"))


def tracked(orders: DataFrame, books: DataFrame) -> DataFrame:
    """Companies with an order or an order book."""
    return orders.select("company_id").union(books.select("company_id")).distinct()


def new_only(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet."""
    return batch.join(known.select(key).distinct(), key, "left_anti")


def candidates(filings: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """Unread filings, one for each company, day and kind, by kind and then newest."""
    rank = F.create_map(*[F.lit(x) for kv in D.BOOK_PRIORITY.items() for x in kv])
    left = filings.join(done, "ann_id", "left_anti").withColumn("priority", F.coalesce(F.try_element_at(rank, F.col("kind")), F.lit(7)))
    w = W.partitionBy("company_id", F.to_date("filed_at"), "kind").orderBy(F.desc("filed_at"), "ann_id")
    return left.withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn").orderBy("priority", F.desc("filed_at"), "ann_id").limit(limit)


def plausibility(value: Column, is_total: Column, revenue: Column, order: Column) -> Column:
    """what speaks against an order-book figure."""
    flags = F.array(F.when(value < 0.98 * order, "smaller than the order"), F.when(value > 40 * revenue, "over 40 years of revenue"), F.when(is_total & (value < 0.02 * revenue), "under 2 % of revenue"))
    return F.filter(flags, lambda x: x.isNotNull())


def budget(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each batch, first come."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("turn") <= most)


def catch_up_start(last_to: Column, to: Column, overlap: int, hours: int, lookback: int) -> Column:
    """R2: where a run begins to read."""
    low = F.greatest(F.timestamp_add("MINUTE", F.lit(-overlap), last_to), F.timestamp_add("HOUR", F.lit(-hours), to))
    base = F.timestamp_add("MINUTE", F.lit(-(lookback + overlap)), to)
    return F.least(F.coalesce(low, base), base)


def near_duplicates(orders: DataFrame, share: float, days: int) -> DataFrame:
    """Orders for which the same company has another of nearly the same value within some days.

    Times and values are dealt to cells four times as wide as what counts as near, and the other side goes to every cell that its
    near ones can be in (one or two of each), so the join is an equality on company, time cell and value cell: a company of many
    orders meets only those like it. Of ln(1 + share * value) two near values differ by -ln(1 - share) at most.
    """
    span, wide = days * 86400, -math.log(1 - share) * (1 + 1e-9)
    o = orders.select("company_id", "order_id", "order_value_inr", F.unix_seconds("filed_at").alias("at")).withColumn("__v", F.log1p(share * F.greatest(F.col("order_value_inr"), F.lit(0.0))))
    cell = lambda x, near, off: F.floor((x + off * near) / (4 * near))
    both = lambda x, near: F.array_distinct(F.array(cell(x, near, -1), cell(x, near, 1)))
    other = o.select("company_id", F.col("order_id").alias("other_id"), F.col("order_value_inr").alias("other_value"), F.col("at").alias("other_at"), "__v", F.explode(both(F.col("at"), span)).alias("time_cell"))
    other = other.select("company_id", "other_id", "other_value", "other_at", "time_cell", F.explode(both(F.col("__v"), wide)).alias("value_cell"))
    o = o.withColumns({"time_cell": cell(F.col("at"), span, 0), "value_cell": cell(F.col("__v"), wide, 0)})
    near = (F.col("other_id") != F.col("order_id")) & (F.abs(F.col("order_value_inr") - F.col("other_value")) <= F.greatest(F.lit(1.0), share * F.col("order_value_inr"))) & (F.abs(F.col("at") - F.col("other_at")) <= span)
    pairs = o.join(other, ["company_id", "time_cell", "value_cell"]).filter(near)
    return pairs.groupBy("order_id").agg(F.min("other_id").alias("duplicate_of"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_year: Column, year: str, value: list[str], hot: int | None = None) -> DataFrame:
    """For each row the right row of the latest year up to the wanted one; of equal years the largest by its values.

    One order over both sides, a key's right rows before its left ones: nothing is packed, and a row holds one match. A key of
    over `hot` rows is dealt out over many tasks (`windows.last_before`). A row without key or wanted year matches nothing.
    """
    seen = right.filter(F.col(key).isNotNull() & F.col(year).isNotNull()).select(F.col(key), F.col(year).alias("__y"), F.struct(F.col(year), *value).alias("__r"))
    rows = left.select(F.col(key), left_year.alias("__y"), F.struct(*left.columns).alias("__l"))
    both = seen.unionByName(rows, allowMissingColumns=True).withColumn("__left", F.col("__l").isNotNull())
    both = last_before(both, key, ["__y", "__left", "__r"], "__r", hot).filter("__left")
    return both.select("__l.*", F.col(f"__last.{year}").alias(year), *[F.col(f"__last.{v}").alias(v) for v in value])


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """K1: the latest row of each key; columns the new row leaves null keep their old value."""
    names = [c for c in old.columns if c != key]
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy("__v", version).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    both = both.select(key, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in names], F.row_number().over(W.partitionBy(key).orderBy("__v", version)).alias("__n"))
    return both.filter("__n = 1").drop("__n")


def replace_by_filing(old: DataFrame, new: DataFrame, key: str, order: list[Column], most: int = 6) -> DataFrame:
    """K2: the rows of a filing are replaced by its new ones, at most six of them."""
    best = new.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(best, allowMissingColumns=True)


def majority(rows: DataFrame, by: list[str], vote: str, least: int = 3) -> DataFrame:
    """Of each group the value with most votes, the smaller on ties; groups in which none has `least` give no row."""
    votes = rows.filter(F.col(vote).isNotNull()).groupBy(*by, vote).agg(F.count("*").alias("votes"))
    best = votes.groupBy(*by).agg(F.min(F.struct((-F.col("votes")).alias("minus"), F.col(vote).alias("value"))).alias("b"))
    return best.select(*by, F.col("b.value").alias(vote), (-F.col("b.minus")).alias("votes")).filter(F.col("votes") >= least)


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What a rebuild takes away and adds: the key and which."""
    gone = old.select(key).join(new.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    return gone.unionByName(new.select(key).join(old.select(key), key, "left_anti").withColumn("change", F.lit("added")))
