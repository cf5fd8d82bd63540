"""The views a user calls (A7, A10, F14-F16, W9, W12, K6, K7, L6-L9, api_company, api_orderbook)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import scoring, text
from ..functions.calendar import period_text
from ..functions.money import rupees
from . import sequences, views


def company(company_id, companies: DataFrame, fundamentals: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    """One company: its row, its figures, its orders as one each, and how many filings they stand for."""
    own = orders.filter(F.col("company_id") == company_id)
    return {"company": companies.filter(F.col("company_id") == company_id), "fundamentals": fundamentals.filter(F.col("company_id") == company_id), "orders": sequences.collapse(own), "filings": own.agg(F.count("*").alias("n_filings"))}


def find_company(companies: DataFrame, what: str) -> DataFrame:
    """F16."""
    return companies.filter((F.upper("symbol") == what.upper()) | (F.col("bse_code") == what) | (F.col("company_id") == what) | F.col("company_name").ilike(f"%{what}%")).orderBy("company_id").limit(1)


def order_books(series: DataFrame, companies: DataFrame, revenue: DataFrame, orders: DataFrame, *, period: str = "1y", as_of: Column) -> DataFrame:
    """One row a company: last book, growth over the period, book to revenue, last twelve points, wins in the period."""
    days = D.PERIOD_DAYS[period]
    last = series.groupBy("company_id").agg(F.max_by(F.struct("as_of", "order_book_inr", "source_kind"), "as_of").alias("last"), F.array_sort(F.collect_list(F.struct("as_of", "order_book_inr"))).alias("ps"))
    last = last.select("company_id", "last.*", F.transform(F.slice("ps", F.greatest(F.size("ps") - 11, F.lit(1)), F.lit(12)), lambda p: p["order_book_inr"]).alias("history"))
    grown = sequences.growth(series, days).select("company_id", "pct", "days", "suspect")
    wins = views.wins(orders, F.date_sub(as_of, days)).select("company_id", "wins", "wins_inr")
    out = last.join(companies, "company_id", "left").join(grown, "company_id", "left").join(revenue, "company_id", "left").join(wins, "company_id", "left")
    return out.withColumn("ratio", F.col("order_book_inr") / F.nullif(F.col("annual_revenue_inr"), F.lit(0.0)))


def book_page(rows: DataFrame, *, least_book: float = 0.0, least_cap: float | None = None, segments: bool = True, name: str | None = None) -> DataFrame:
    """F14; with `hidden`, rows that only lack a market cap."""
    ok = F.col("order_book_inr") >= least_book
    if not segments:
        ok = ok & (F.col("scope") == "total")
    if name:
        ok = ok & (F.col("company_name").ilike(f"%{name}%") | F.col("symbol").ilike(f"%{name}%"))
    rows = rows.filter(ok)
    return rows if least_cap is None else rows.filter(F.col("market_cap_inr") >= least_cap)


def gainers(rows: DataFrame, n: int = 12) -> DataFrame:
    """Ranked by growth, without suspects."""
    top = rows.filter(F.col("pct").isNotNull() & ~F.coalesce("suspect", F.lit(False))).orderBy(F.desc("pct"), "company_id").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("pct"), "company_id")))  # at most n rows


#: Components by weight, as messages name them.
PARTS = {"f_annualised": ("size by year", 40), "f_quarterly": ("size by quarter", 20), "f_firmness": ("firmness", 15), "f_margin": ("margin", 10), "f_novelty": ("novelty", 10), "f_capacity": ("capacity", 5)}


def notes_shown(notes: Column, most: int = 2) -> Column:
    """The readable ones of an order's extraction notes ("a; b; ..."), without their steps of confidence."""
    parts = F.transform(F.split(notes, ";"), lambda p: F.trim(p))
    said = F.filter(parts, lambda p: (p != "") & ~F.rlike(p, F.lit(r"^[+-]\d")))
    return F.transform(F.slice(said, 1, most), lambda p: text.clip(F.regexp_replace(p, r"(?i)^order evidence:\s*", ""), 110))


def message(scored: DataFrame, company_url: str | None = None) -> DataFrame:
    """A line a fact, the three components that carry most, three reasons, two notes, and links to filing and company.

    Columns extraction_notes, pdf_url and symbol are used where `scored` has them; `company_url` has {key} for the symbol.
    """
    has = lambda n: F.col(n) if n in scored.columns else F.lit(None).cast("string")
    parts = F.array(*[F.struct((-F.round(F.col(c) * w, 2)).alias("minus"), F.lit(label).alias("label"), F.col(c).alias("share")) for c, (label, w) in PARTS.items()])
    top = F.transform(F.slice(F.array_sort(parts), 1, 3), lambda p: F.concat(text.bar(p["share"]), F.lit(" "), p["label"]))
    why = F.transform(F.slice(scoring.reasons(), 1, 3), lambda r: F.concat(F.lit("• "), text.escape(text.clip(r, 110))))
    notes = F.transform(notes_shown(has("extraction_notes")), lambda n: F.concat(F.lit("? "), text.escape(n)))
    detail = F.concat(F.coalesce(why, F.array().cast("array<string>")), F.coalesce(notes, F.array().cast("array<string>")))
    link = lambda url, label: F.concat(F.lit('<a href="'), text.escape(url), F.lit(f'">{label}</a>'))
    about = F.replace(F.lit(company_url or ""), F.lit("{key}"), has("symbol")) if company_url else F.lit(None).cast("string")
    links = F.nullif(F.concat_ws(" ", link(has("pdf_url"), "filing"), link(about, "company")), F.lit(""))
    lines = F.concat_ws("\n", F.concat(F.lit("<b>"), text.escape(F.col("company_name")), F.lit("</b> "), F.col("tier"), F.lit(" "), F.format_number("score", 1)), F.concat(rupees(F.col("order_value_inr")), F.lit(" over "), period_text(F.col("execution_months"))), F.when(F.col("ratio_quarter").isNotNull(), F.concat(F.format_number(F.col("ratio_quarter") * 100, 0), F.lit("% of a quarter"))), F.array_join(top, "\n"), F.nullif(F.array_join(detail, "\n"), F.lit("")), links)
    return scored.select("order_id", text.clip(lines, 4000).alias("message"))


def digest(orders: DataFrame, n: int = 25) -> DataFrame:
    """K6."""
    return orders.filter("tier = 'WATCH'").orderBy(F.desc("score"), "order_id").limit(n)


