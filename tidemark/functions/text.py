"""Text cleaning and classification as column expressions.

Each word list is one literal alternation, so Catalyst folds it and nothing is joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D


def any_word(words: list[str], plural: bool = False) -> str:
    """Whole-word alternation; in Java syntax."""
    tail = "(?:s|es)?" if plural else ""
    return r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(re.escape(w) for w in words) + ")" + tail + r"(?![A-Za-z0-9])"


def any_part(words: list[str]) -> str:
    return "(?i)(?:" + "|".join(re.escape(w) for w in words) + ")"


def either(patterns: list[str]) -> str:
    return "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def joined(*texts: Column) -> Column:
    return F.concat_ws(" ", *texts)


def clean_html(x: Column) -> Column:
    """Tags gone, five entities decoded, white space squeezed; empty is null."""
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def clean_text(x: Column) -> Column:
    """Ligature codes and smart quotes replaced, white space squeezed."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"\(cid:\d+\)", "")
    return F.trim(F.regexp_replace(F.translate(x, "‘’“”–—", "''\"\"--"), r"\s+", " "))


def company_key(name: Column) -> Column:
    """T4: one spelling for a company: upper case, legal suffixes and all punctuation gone."""
    x = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"-\$+\s*$", " ")
    return F.regexp_replace(F.regexp_replace(x, "(?i)" + D.LEGAL_SUFFIX, " "), "[^A-Z0-9]+", "")


def clean_customer(name: Column) -> Column:
    """T5."""
    x = F.btrim(F.regexp_replace(name, r"\s+", " "), F.lit(" ,.;:-"))
    return F.substring(F.regexp_replace(x, r"(?i)^(?:the|a|an|our|its|their)\s+", ""), 1, 120)


def junk_customer(name: Column) -> Column:
    start = "(?i)^(?:" + "|".join(re.escape(w) for w in D.JUNK_CUSTOMERS) + ")"
    return (F.char_length(name) < 4) | F.rlike(name, F.lit(start)) | ~(F.rlike(name, F.lit(r"\b[A-Z][a-z]{2,}")) | ((name == F.upper(name)) & (name != F.lower(name))))


def customer(text: Column, company: Column) -> Column:
    """struct(name, is_self): the first counterparty that is neither junk nor the filing company."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?im){p}"), F.lit(1)) for p in D.CUSTOMER_PATTERNS])
    good = F.filter(F.transform(found, clean_customer), lambda n: ~junk_customer(n))
    own = company_key(company)
    mine = lambda n: (F.char_length(own) >= 5) & (F.char_length(company_key(n)) >= 5) & (F.contains(company_key(n), own) | F.contains(own, company_key(n)))
    other = F.filter(good, lambda n: ~mine(n))
    return F.struct(F.get(other, 0).alias("name"), ((F.size(other) == 0) & F.exists(good, mine)).alias("is_self"))


def customer_type(name: Column, text: Column) -> Column:
    """T7."""
    both = F.concat(F.lower(joined(name, text)), F.lit(" "))
    has = lambda words: F.rlike(both, F.lit(any_part(words)))
    return F.when(has(D.PUBLIC_SECTOR), "psu").when(has(D.GOVERNMENT), "government").when(has(D.EXPORT), "export").when(name.isNotNull(), "private").otherwise("unknown")


def looks_like_order(*texts: Column) -> Column:
    """F2."""
    x = F.lower(joined(*texts))
    return F.rlike(x, F.lit(any_word(D.ORDER_TRIGGERS))) | F.rlike(x, F.lit(either(D.ORDER_PATTERNS)))


def non_order(*texts: Column) -> Column:
    """the first marker, by list order, that makes this no commercial order; else null."""
    x = F.lower(joined(*texts))
    out = F.lit(None).cast("string")
    for p in reversed(D.NON_ORDER_PATTERNS):
        out = F.when(F.rlike(x, F.lit("(?i)" + p)), F.regexp_extract(x, f"(?i)({p})", 1)).otherwise(out)
    for w in reversed(D.NON_ORDER):
        out = F.when(F.contains(x, F.lit(w)), F.lit(w)).otherwise(out)
    return out


def worth_probe(headline: Column, subcategory: Column) -> Column:
    """a headline that says nothing, and none that can never be an order."""
    x = F.lower(joined(headline, subcategory))
    return ~F.rlike(x, F.lit(any_part(D.NEVER_ORDER))) & non_order(headline, subcategory).isNull() & F.rlike(x, F.lit(any_part(D.GENERIC_HEADLINES)))


def own_project(text: Column) -> Column:
    """signs that the company builds for itself."""
    hits = F.array(*[F.rlike(text, F.lit("(?i)" + p)) for p in D.OWN_PROJECT])
    return F.size(F.filter(hits, lambda h: h)) >= D.OWN_PROJECT_LEAST


def order_type(text: Column) -> Column:
    """struct(order_type, firmness) of the firmest phrase."""
    x, out = F.lower(text), F.struct(F.lit("unknown").alias("order_type"), F.lit(0.5).alias("firmness"))
    for firmness, words in reversed(D.FIRMNESS.items()):
        for w in reversed(words):
            out = F.when(F.rlike(x, F.lit(any_word([w], plural=True))), F.struct(F.lit(w).alias("order_type"), F.lit(firmness).alias("firmness"))).otherwise(out)
    return out


def amendment(lead: Column) -> Column:
    """T9."""
    return F.rlike(F.lower(lead), F.lit(any_word(D.AMENDMENTS)))


def quality_adjustment(text: Column) -> Column:
    """Bumps match anywhere, dings whole words; between -0.4 and 0.5."""
    x = F.lower(text)
    total = F.lit(0.0)
    for w, points in D.QUALITY_BUMPS.items():
        total = total + F.when(F.contains(x, F.lit(w)), points).otherwise(0.0)
    for w, points in D.QUALITY_DINGS.items():
        # the search by letter is only for texts that hold the word at all
        total = total + F.when(F.contains(x, F.lit(w)) & F.rlike(x, F.lit(any_word([w]))), points).otherwise(0.0)
    return F.greatest(F.lit(-0.4), F.least(F.lit(0.5), total))


def not_order_topic(*texts: Column) -> Column:
    return F.rlike(F.lower(joined(*texts)), F.lit(any_part(D.NOT_ORDER_TOPICS)))


def subject(text: Column) -> Column:
    """The text of a "Sub:" line."""
    return F.nullif(F.regexp_extract(F.substring(F.regexp_replace(text, r"\s+", " "), 1, 4000), r"(?i)\bsub(?:ject)?\s*[:.\-–]\s*(.{5,220}?)(?=\s+(?:dear|ref\b|respected|pursuant|with\s+reference|in\s+terms\s+of|we\s)|$)", 1), F.lit(""))


def yes_no(answer: Column) -> Column:
    """The answer of a disclosure table."""
    x = F.lower(F.trim(answer))
    return F.when(F.rlike(x, F.lit(r"^(?:no\b|nil\b|none\b|n\.?a\.?\b|not applicable)")), False).when(F.rlike(x, F.lit(r"^yes\b")), True)


def book_candidate(*texts: Column) -> Column:
    """F10."""
    x = joined(*texts)
    return F.rlike(x, F.lit("(?i)" + D.BOOK_CANDIDATE)) & ~F.rlike(x, F.lit("(?i)" + D.BOOK_NOT_CANDIDATE))


def mentions_book(*texts: Column) -> Column:
    """F11."""
    return F.rlike(F.lower(joined(*texts)), F.lit(any_part(D.BOOK_MENTIONS)))


def document_kind(category: Column, subcategory: Column, headline: Column, is_order: Column) -> Column:
    """What kind of document states an order book."""
    x = F.lower(joined(category, subcategory, headline))
    ladder = [("transcript", "transcript"), ("presentation", "presentation"), (r"annual\s+report", "annual"), (r"order\s*book|order\s+position|unexecuted", "update"), (r"financial\s+result|results?\s+press|earnings\s+(?:update|release)", "results"), (r"(?:press|media)\s+release", "press_release")]
    out = F.when(is_order, "order_win").otherwise("other")
    for pattern, kind in reversed(ladder):
        out = F.when(F.rlike(x, F.lit(pattern)), kind).otherwise(out)
    return out


def escape(x: Column) -> Column:
    """Text for an HTML message."""
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def clip(x: Column, n: int) -> Column:
    return F.when(F.char_length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 1)), F.lit("…"))).otherwise(x)


def bar(share: Column, width: int = 10) -> Column:
    full = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))
