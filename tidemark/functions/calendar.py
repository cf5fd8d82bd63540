"""Durations, dates and the April-March year as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from .scoring import bind

_WORDS = "|".join(sorted(D.NUMBER_WORDS, key=len, reverse=True))
# The looks ahead tell in one step that nothing can begin at a place: the first letter of a number, the first two of a lead.
TOKEN = rf"(?=[\d{''.join(sorted({w[0] for w in D.NUMBER_WORDS}))}])(?:\d{{1,3}}(?:\.\d+)?|{_WORDS})"
LEAD = rf"(?=[cdefiopstvw][aeinoprtuvx])(?:{D.DURATION_LEADS})"
SPAN = rf"({TOKEN})[-\s]*(months?|years?|yrs?|weeks?|days?)\b"


def number(token: Column) -> Column:
    """D1."""
    words = F.create_map(*[F.lit(x) for k, v in D.NUMBER_WORDS.items() for x in (k, float(v))])
    return bind(token, lambda t: F.coalesce(t.try_cast("double"), F.try_element_at(words, F.lower(t))))


def months(n: Column, unit: Column) -> Column:
    """Null outside 0.1 to 240 months."""
    length = lambda x: F.when(x["u"] == "y", x["n"] * 12).when(x["u"] == "m", x["n"]).when(x["u"] == "w", x["n"] / 4.33).when(x["u"] == "d", x["n"] / 30.44)
    # bound: number and unit come out of searches, which an expression that names them often would do again each time
    read = F.struct(n.alias("n"), F.lower(F.substring(unit, 1, 1)).alias("u"))
    return bind(bind(read, length), lambda m: F.when((m >= 0.1) & (m <= 240), m))


def _first(text: Column, pattern: str, at_end: bool) -> Column:
    """The first valid duration among all matches of a pattern that begins or ends with number and unit; matched once."""
    span = rf"(?i){SPAN}$" if at_end else rf"(?i)^{SPAN}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    length = lambda x: months(number(F.regexp_extract(x, span, 1)), F.regexp_extract(x, span, 2))
    return F.get(F.filter(F.transform(found, length), lambda m: m.isNotNull()), 0)


def duration_months(text: Column, as_of: Column) -> Column:
    """A table label, then leading phrases, trailing phrases, and a completion month counted from `as_of`."""
    labelled = F.when(F.rlike(text, F.lit(r"(?i)time\s*period")), _first(text, rf"(?i){D.DURATION_LABEL}[\s\S]{{0,320}}?\b{SPAN}", True))
    lead = _first(text, rf"(?i){LEAD}\s*(?:a\s+period\s+of\s+)?(?:approximately\s+|about\s+|approx\.?\s+)?{SPAN}", True)
    tail = _first(text, rf"(?i)({TOKEN})[-\s]*(months?|years?|yrs?|weeks?|days?)\s*(?:{D.DURATION_TAILS})", False)
    end = r"(?i)(?:by|before|on or before|latest by|complet\w+ by)\s+(?:end of\s+)?(?:FY\s?)?(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[,\s]+(20\d{2})"
    month = F.ceil(F.position(F.lower(F.regexp_extract(text, end, 1)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) / 3)
    year = F.nullif(F.regexp_extract(text, end, 2), F.lit("")).cast("int")
    away = (year - F.year(as_of)) * 12 + (month - F.month(as_of))
    return F.coalesce(labelled, lead, tail, F.when((away >= 1) & (away <= 120), away.cast("double")))


def fiscal_year(d: Column) -> Column:
    """The year in which the April-March year of a date ends."""
    return F.year(d) + F.when(F.month(d) >= 4, 1).otherwise(0)


def quarter_end_before(d: Column) -> Column:
    """The last quarter end strictly before a date."""
    return F.date_sub(F.trunc(d, "quarter"), 1)


def fiscal_year_end_before(d: Column) -> Column:
    """The last 31 March strictly before a date."""
    return F.make_date(F.year(d) - F.when(F.date_format(d, "MMdd") > "0331", 0).otherwise(1), F.lit(3), F.lit(31))


def quarter_label(d: Column) -> Column:
    """D13."""
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def stamp(x: Column) -> Column:
    """The first of the venues' formats that fits, read as Indian time, as UTC; a T before the time is a blank."""
    formats = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "d MMM yyyy HH:mm:ss", "d-MM-yyyy HH:mm:ss", "yyyy-MM-dd", "d-MMM-yyyy HH:mm:ss", "d/MM/yyyy HH:mm:ss"]
    x = F.regexp_replace(F.trim(x), r"(?<=\d)T(?=\d)", " ")
    return F.to_utc_timestamp(F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats]), "Asia/Kolkata")


def market_hours(at: Column, opens: str = "09:00", closes: str = "18:00", weekends: bool = False) -> Column:
    """whether a moment (UTC) is within the hours of a scan in Indian time, both ends included; null is outside."""
    local = F.from_utc_timestamp(at, "Asia/Kolkata")
    minute = F.date_format(local, "HH:mm:ss.SSSSSS")
    inside = (minute >= F.lit(f"{opens}:00.000000")) & (minute <= F.lit(f"{closes}:00.000000"))
    return F.coalesce(inside if weekends else inside & (F.weekday(local) < 5), F.lit(False))


def days_apart(a: Column, b: Column) -> Column:
    """Whole days between, the difference floored before its sign goes; very far if either is missing."""
    return F.coalesce(F.abs(F.floor((F.unix_seconds(a) - F.unix_seconds(b)) / 86400)).cast("double"), F.lit(1e9))


def stale(at: Column, now: Column, days: int) -> Column:
    """A missing stamp is stale."""
    return F.coalesce(F.unix_seconds(now) - F.unix_seconds(at) > days * 86400, F.lit(True))


def period_text(months_: Column) -> Column:
    """D18."""
    years = months_ / 12
    whole = F.abs(years - F.bround(years)) < 0.01
    return F.when(months_ < 1, F.concat(F.bround(months_ * 30.44).cast("int").cast("string"), F.lit(" days"))).when((months_ >= 24) & whole, F.concat(F.bround(years).cast("int").cast("string"), F.lit(" years"))).otherwise(F.concat(F.bround(months_).cast("int").cast("string"), F.lit(" months")))
