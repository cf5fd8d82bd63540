"""Figures out of landed web pages (S13, S15, S20's text rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_html

_N = r"([\d,]+(?:\.\d+)?)"


def number(x: Column) -> Column:
    """A cell as a number."""
    return F.regexp_replace(F.trim(x), "[,%₹]", "").try_cast("double")


def market_cap(page: Column) -> Column:
    """S15, in rupees."""
    text = clean_html(page)
    n = number(F.regexp_extract(text, rf"(?i)market\s+cap[^\d]{{0,20}}{_N}\s*(?:cr|crore)", 1))
    return n * 1e7


def basis(page: Column) -> Column:
    return F.when(F.rlike(page, F.lit(r"(?i)consolidated\s+figures")), "consolidated").when(F.rlike(page, F.lit(r"(?i)standalone\s+figures")), "standalone")


def title(page: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def annuals(page: Column) -> Column:
    """array<struct<fy, sales, other_income, net_profit>> in rupees from the profit-and-loss table."""
    section = F.regexp_extract(page, r'(?is)<section[^>]*id="profit-loss"[^>]*>(.*?)</section>', 1)
    heads = F.regexp_extract_all(section, F.lit(r"(?is)<th[^>]*>\s*Mar\s+(\d{4})\s*</th>"), F.lit(1))

    def row(label: str) -> Column:
        tr = F.regexp_extract(section, rf"(?is)<tr[^>]*>\s*<td[^>]*>(?:(?!</td>).)*?{label}(?:(?!</td>).)*</td>((?:(?!</tr>).)*)</tr>", 1)
        return F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: number(clean_html(c)) * 1e7)

    z = F.arrays_zip(heads.alias("fy"), row("Sales").alias("sales"), row("Other Income").alias("other_income"), row("Net Profit").alias("net_profit"))
    return F.transform(z, lambda x: F.struct(x["fy"].cast("int").alias("fy"), x["sales"].alias("sales"), x["other_income"].alias("other_income"), x["net_profit"].alias("net_profit")))


def squeeze(text: Column, most: int = 40_000) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")), 1, most)
