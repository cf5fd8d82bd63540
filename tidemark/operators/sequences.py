"""Ordered-sequence operators (W1-W13, A6-A8). Greedy, order-dependent groupings are folds over a company's sorted array."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions.calendar import quarter_label
from .components import components
from .windows import trailing_median


def novelty_history(orders: DataFrame, days: int = 720) -> DataFrame:
    """Median and number of a company's earlier orders in the trailing days, strictly before each."""
    counted = (F.col("order_value_inr") > 0) & ~F.coalesce("is_amendment", F.lit(False))
    return trailing_median(orders, ["company_id"], F.unix_seconds("filed_at"), F.when(counted, F.col("order_value_inr")), days * 86400, "history_median", "history_n")


def quarterly_metrics(quarters: DataFrame, value: str = "revenue") -> DataFrame:
    """Of each company its latest quarter, the four and the four before, and growth on the year."""
    r = quarters.withColumn("k", F.row_number().over(W.partitionBy("company_id").orderBy(F.desc("quarter"))))
    total = lambda a, b: F.sum(F.when(F.col("k").between(a, b), F.col(value)))
    out = r.filter("k <= 8").groupBy("company_id").agg(total(1, 1).alias("latest"), total(1, 4).alias("ttm"), total(5, 8).alias("previous_ttm"), total(5, 5).alias("year_ago"), F.count("*").alias("n"))
    return out.withColumn("yoy_latest", F.col("latest") - F.col("year_ago"))


def sessions(df: DataFrame, by: list[str], at: Column, gap: Column | int, descending: bool = False) -> DataFrame:
    """`df` with `__session`, which rises at gaps of over `gap`: a fold never reaches over one, so it runs session by session."""
    w = W.partitionBy(*by).orderBy(F.col("__at").desc() if descending else F.col("__at"))
    apart = F.abs(F.col("__at") - F.lag("__at").over(w)) > gap
    df = df.withColumn("__at", at).withColumn("__cut", F.coalesce(apart, F.lit(False)).cast("int"))
    return df.withColumn("__session", F.sum("__cut").over(w)).drop("__at", "__cut")


def greedy_groups(df: DataFrame, by: list[str], at: Column, days: int, keep: list[str]) -> DataFrame:
    """Dates in groups, each within `days` of the group's first; `at` is a day number. One row of `df` keeps its columns and gets `anchor`."""
    df = sessions(df, by, at.cast("long"), days)
    rows = df.select(*by, "__session", F.struct(at.cast("long").alias("d"), *keep).alias("r")).groupBy(*by, "__session").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    start = F.struct(F.lit(None).cast("long").alias("anchor"), F.array().cast("array<bigint>").alias("out"))
    anchor = lambda acc, x: F.when(acc["anchor"].isNull() | (x["d"] - acc["anchor"] > days), x["d"]).otherwise(acc["anchor"])
    anchors = F.aggregate("rs", start, lambda acc, x: F.struct(anchor(acc, x).alias("anchor"), F.concat(acc["out"], F.array(anchor(acc, x))).alias("out")), lambda acc: acc["out"])
    return rows.select(*by, F.explode(F.arrays_zip(F.col("rs").alias("r"), anchors.alias("anchor"))).alias("z")).select(*by, "z.r.*", "z.anchor")


def best_per_quarter(points: DataFrame) -> DataFrame:
    """Of each company and calendar quarter the best-sourced statement."""
    rank = F.create_map(*[F.lit(x) for kv in D.SOURCE_RANK.items() for x in kv])
    better = F.struct(-F.coalesce(F.try_element_at(rank, F.col("source_kind")), F.lit(3)), "as_of", "confidence", "filed_at", "ann_id")
    p = points.withColumn("quarter", quarter_label(F.col("as_of")))
    cols = [c for c in points.columns if c != "company_id"]
    return p.groupBy("company_id", "quarter").agg(F.max_by(F.struct(*cols), better).alias("p")).select("company_id", "quarter", "p.*")


def drop_restated(points: DataFrame, tolerance: float = 1e5) -> DataFrame:
    """An undated figure equal to the last kept one is no new reading."""
    cols = [c for c in points.columns if c not in ("company_id", "as_of")]
    g = points.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("as_of", *cols))).alias("ps"))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))["order_book_inr"]
    again = lambda acc, p: F.coalesce(F.abs(p["order_book_inr"] - last(acc)) < tolerance, F.lit(False)) & (p["as_of_basis"] != "stated")
    kept = F.aggregate("ps", F.slice("ps", 1, 0), lambda acc, p: F.when(again(acc, p), acc).otherwise(F.concat(acc, F.array(p))))
    return g.select("company_id", F.inline(kept))


def build_series(snapshots: DataFrame) -> DataFrame:
    """One point for each company and quarter: the whole book if any is stated, else its segments."""
    s = snapshots.filter(~F.coalesce(F.exists("flags", lambda f: F.contains(f, F.lit("unit error")) | F.contains(f, F.lit("not the whole book"))), F.lit(False)))
    s = s.withColumn("__total", F.max((F.col("scope") == "total").cast("int")).over(W.partitionBy("company_id")))
    s = s.filter((F.col("__total") == 0) | (F.col("scope") == "total")).withColumn("scope", F.when(F.col("__total") == 1, "total").otherwise("segment")).drop("__total", "flags")
    cols = [c for c in s.columns if c not in ("company_id", "ann_id")]
    g = greedy_groups(s, ["company_id", "ann_id"], F.unix_date("as_of"), 31, cols)
    largest = g.groupBy("company_id", "ann_id", "anchor").agg(F.max_by(F.struct(*cols), F.struct("order_book_inr", "as_of")).alias("p")).select("company_id", "ann_id", "p.*")
    return drop_restated(best_per_quarter(largest))


def growth(series: DataFrame, days: int) -> DataFrame:
    """From the first point inside the period to the last, if far enough apart; `suspect` for steps of 4 and more."""
    g = series.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("as_of", "order_book_inr"))).alias("ps"))
    g = g.filter(F.size("ps") >= 2).withColumn("last", F.element_at("ps", -1))
    age = lambda p: F.datediff(F.col("last")["as_of"], p["as_of"])
    g = g.withColumn("base", F.get(F.filter("ps", lambda p: (age(p) <= days) & (age(p) >= D.LEAST_GROWTH_DAYS)), 0))
    g = g.filter(F.col("base").isNotNull() & (F.col("base.order_book_inr") != 0))
    path = F.filter("ps", lambda p: p["as_of"] >= F.col("base")["as_of"])
    g = g.withColumn("path", F.transform(path, lambda p: p["order_book_inr"]))
    steps = F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1), lambda a, b: (a != 0) & ~((b / a > 1 / D.SUSPECT_STEP) & (b / a < D.SUSPECT_STEP)))
    return g.select("company_id", (F.col("last.order_book_inr") / F.col("base.order_book_inr") - 1).alias("pct"), F.col("base.as_of").alias("from_as_of"), F.col("base.order_book_inr").alias("from_value"), F.datediff("last.as_of", "base.as_of").alias("days"), F.exists(steps, lambda x: x).alias("suspect"))


def same_order(a: Column, b: Column) -> Column:
    """Equal values (half a percent) within three days; without both values, the same day and order type."""
    both = a["order_value_inr"].isNotNull() & b["order_value_inr"].isNotNull()
    close = (F.abs(a["order_value_inr"] - b["order_value_inr"]) <= F.greatest(F.lit(1.0), F.abs(a["order_value_inr"]) * 0.005)) & (F.abs(F.floor((a["at"] - b["at"]) / 86400)) <= 3)
    loose = (F.floor(a["at"] / 86400) == F.floor(b["at"] / 86400)) & (F.coalesce(a["order_type"], F.lit("")) == F.coalesce(b["order_type"], F.lit("")))
    return F.when(both, close).otherwise(loose)


#: Of ln(1 + share * value) two values that `same_order` takes for equal differ by this at most.
_NEAR = -math.log(1 - 0.005) * (1 + 1e-9)


def possible_twins(orders: DataFrame) -> DataFrame:
    """Edges (a, b) between filings (company_id, order_id, at, order_value_inr, order_type) that join all `same_order` can hold of.

    Equal values are in one of two grids of value cells, less than four days apart; a filing without a value is of the day and
    kind of its like. In each cell a filing is tied to the one before it, so there are at most three edges a filing, and a
    company that files all the time is as many groups as it has values and days.
    """
    x = F.log1p(0.005 * F.greatest(F.col("order_value_inr"), F.lit(0.0))) / (2 * _NEAR)
    day = F.floor(F.col("at") / 86400)
    valued = F.array(F.struct(F.lit("a").alias("grid"), F.floor(x).alias("cell"), F.lit("").alias("kind")), F.struct(F.lit("b").alias("grid"), F.floor(x + 0.5).alias("cell"), F.lit("").alias("kind")))
    dated = F.array(F.struct(F.lit("d").alias("grid"), day.alias("cell"), F.coalesce("order_type", F.lit("")).alias("kind")))
    cells = orders.select("company_id", "order_id", "at", F.col("order_value_inr").isNull().alias("bare"), F.inline(F.when(F.col("order_value_inr").isNull(), dated).otherwise(F.concat(valued, dated))))
    w = W.partitionBy("company_id", "grid", "cell", "kind")
    row = w.orderBy("at", "order_id")
    before = F.struct(F.lag("order_id").over(row).alias("id"), F.lag("at").over(row).alias("at"))
    ties = cells.withColumns({"before": before, "some": F.max("bare").over(w)})
    close = F.when(F.col("grid") == "d", F.col("some")).otherwise(F.col("at") - F.col("before.at") <= 4 * 86400)
    return ties.filter(F.col("before.id").isNotNull() & close).select(F.col("order_id").alias("a"), F.col("before.id").alias("b"))


def collapse(orders: DataFrame) -> DataFrame:
    """Filings of one order as one row, newest first: each joins the first group whose head it matches.

    The fold over heads runs inside components of `possible_twins`, which no match leaves; a filing that may match no other
    needs none. The best-read filing stays (a value, then months, then the score; the earlier in order on ties);
    `exchanges` and `duplicate_filings` say what it stands for. An order_id stands for one filing.
    """
    d = orders.select("company_id", "order_id", "filed_at", F.unix_seconds("filed_at").alias("at"), "exchange", "order_value_inr", "order_type", "execution_months", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    of = components(possible_twins(d)).select(F.col("node").alias("order_id"), F.col("component").alias("__of"))
    d = d.withColumn("__newest", -F.col("at")).join(of, "order_id", "left")
    alone = d.filter("__of IS NULL").select("company_id", "order_id", "order_value_inr", F.when(F.col("exchange").isNotNull(), F.array("exchange")).otherwise(F.array().cast("array<string>")).alias("exchanges"), F.lit(1).cast("long").alias("duplicate_filings"))
    row = F.struct("__newest", "order_id", "at", "exchange", "order_value_inr", "order_type", "execution_months", "score")
    g = d.filter("__of IS NOT NULL").groupBy("company_id", "__of").agg(F.array_sort(F.collect_list(row)).alias("rs"))
    none = F.array().cast("array<int>")
    find = lambda rs, heads, x: F.get(F.filter(heads, lambda h: same_order(F.element_at(rs, h), x)), 0)
    # the fold keeps the positions of the heads, and for each row the head it joins
    acc0 = F.struct(none.alias("heads"), none.alias("of"))

    def step(acc: Column, k: Column) -> Column:
        own = F.coalesce(find(F.col("rs"), acc["heads"], F.element_at("rs", k)), k)
        return F.struct(F.when(own == k, F.concat(acc["heads"], F.array(k))).otherwise(acc["heads"]).alias("heads"), F.concat(acc["of"], F.array(own)).alias("of"))

    of = F.aggregate(F.sequence(F.lit(1), F.size("rs")), acc0, step, lambda acc: acc["of"])
    rows = g.select("company_id", "__of", F.explode(F.arrays_zip(F.col("rs").alias("r"), of.alias("head"))).alias("z")).select("company_id", "__of", "z.r.*", F.col("z.head").alias("head"))
    best = F.struct(F.col("order_value_inr").isNotNull(), F.col("execution_months").isNotNull(), "score", -F.col("__newest"), -F.col("order_id"))
    folded = rows.groupBy("company_id", "__of", "head").agg(F.max_by("order_id", best).alias("order_id"), F.max_by("order_value_inr", best).alias("order_value_inr"), F.array_sort(F.collect_set("exchange")).alias("exchanges"), F.count("*").alias("duplicate_filings")).drop("head", "__of")
    return folded.unionByName(alone)


def feed_alarm(runs: DataFrame) -> DataFrame:
    """Runs at which the last three have all failed."""
    w = W.partitionBy("feed").orderBy("run_id").rowsBetween(-2, 0)
    r = runs.withColumn("alarm", F.bool_and("failed").over(w) & (F.count("*").over(w) == 3))
    return r.filter("alarm").drop("alarm")
