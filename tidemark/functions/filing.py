"""From a filing's texts to an order.

`extract` first decides which filings can be orders: one scan of each text for all word lists (`scan`), the statement of a
receipt, the evidence. That is written once; only filings with evidence go on to what reads figures, names and phrases.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dictionaries as D
from ..shared import cut
from . import calendar, money, orderbook, scan, scoring, text
from .repeats import remembered

_RECEIPTS = [re.compile(p, re.I) for p in D.RECEIPTS]
_BEFORE, _AFTER, _PENDING, _LEAD, _STOP, _JUNK = (re.compile(p, re.I) for p in (D.RECEIPT_VETO_BEFORE, D.RECEIPT_VETO_AFTER, D.RECEIPT_PENDING, D.OBJECT_LEAD, D.OBJECT_STOP, D.OBJECT_JUNK))
_NOUN = re.compile(rf"\b{D.RECEIPT_NOUN}\b", re.I)
LONGEST = 150


@remembered
def receipt(said: str | None) -> str | None:
    """the first statement that an order was received which nothing around it takes back."""
    said = said or ""
    for p in _RECEIPTS:
        for m in p.finditer(said):
            if not (_BEFORE.search(said[max(0, m.start() - 40) : m.end()]) or _AFTER.search(said[m.start() : m.end() + 40]) or _PENDING.search(said[max(0, m.start() - 30) : m.start()])):
                return re.sub(r"\s+", " ", m[0])[:80]
    return None


def _rated_scope(said: str | None, weight: float = 2.0) -> tuple[float, str] | None:
    """The best phrase behind a lead that stands near the word for an order, and its points."""
    said = re.sub(r"\s+", " ", said or "").strip()
    best: tuple[float, str] | None = None
    for m in _LEAD.finditer(said):
        pre = re.split(r"[.;!?]\s+(?=[A-Z\"(])", said[max(0, m.start() - 260) : m.start()])[-1]
        nouns = list(_NOUN.finditer(pre))
        if not nouns or len(pre) - nouns[-1].end() > 150:
            continue
        rest = said[m.end() : m.end() + 400]
        stop = _STOP.search(rest)
        phrase = (rest[: stop.start()] if stop else rest[: rest.rfind(" ") if len(rest) == 400 else 400]).strip(" ,;:-/'\"*.")
        phrase = re.sub(r"(?:\s+(?:of|and|or|the|for|to|in|with|an?|by|at|from|under|on|as))+$", "", phrase)
        words = re.findall("[A-Za-z]{2,}", phrase)
        term = re.match(r"(?:an?\s+|the\s+)?(?:period|term|tenure)\s+of\b|\S+\s+(?:years?|months?|weeks?|days?)\b|(?:approx|rs|inr|usd|₹|\d)", phrase, re.I)
        if len(words) < 2 or len(phrase) < 10 or term or _JUNK.search(phrase):
            continue
        points = weight + any(p.search(pre) for p in _RECEIPTS) + min(len(words), 12) / 12 - (len(words) > 40)
        if best is None or points > best[0]:
            best = (points, phrase)
    return best


def scope(said: str | None) -> str | None:
    """What one text says an order is for."""
    best = _rated_scope(said)
    return best and best[1]


@remembered
def rated(headline: str | None, body: str | None, attachment: str | None) -> dict | None:
    """The best phrase of a filing's texts, the earlier on ties; a headline's weighs a little less."""
    found = [x for x in (_rated_scope(body), _rated_scope(attachment), _rated_scope(headline, 1.8)) if x]
    return dict(zip(("points", "phrase"), max(found, key=lambda x: x[0]))) if found else None


receipt_statement = F.udf(receipt, T.StringType(), useArrow=True)
order_scope = F.udf(rated, T.StructType([T.StructField("points", T.DoubleType()), T.StructField("phrase", T.StringType())]), useArrow=True)


def tidy(x: Column) -> Column:
    """A phrase without quotes, marks and loose words at its end."""
    x = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^[ ,;:\-/'\"*.]+|[ ,;:\-/'\"*.]+$", ""), '"', "")
    return F.regexp_replace(x, r"(?i)(?:\s+(?:of|and|or|the|for|to|in|with|an?|by|at|from|under|on|as|via|through|including|be|is|are|&))+$", "")


def _row_of_table(said: Column, label: str, most: int) -> Column:
    """The words behind a label up to the next row of a table; null where they are no answer."""
    said = F.regexp_replace(said, r"\s+", " ")
    group = lambda k: F.nullif(F.regexp_extract(said, rf"(?i){label}(?:(.{{12}}.{{0,{most}}}?)(?=(?:{D.TABLE_NEXT})|$)|(.{{12,{most}}})\s)", k), F.lit(""))
    found = F.coalesce(group(1), group(2))
    bare = tidy(F.regexp_replace(F.regexp_replace(found, "(?i)" + D.TABLE_WORDS, " "), r"(?i)^\s*(?:of\s+)?(?:the\s+)?(?:order|contract)s?\b|^[\s:;,.\-/]*(?:m/s\.?\s*)?", " "))
    return scoring.bind(bare, lambda answer: F.when((F.char_length(answer) >= 3) & ~F.rlike(answer, F.lit("(?i)" + D.TABLE_SAYS_NOTHING)), answer))


def table_phrase(said: Column) -> Column:
    """Y2: what a table in running text says the work is."""
    return tidy(F.regexp_replace(_row_of_table(said, D.TABLE_WORK, 420), rf"(?i)(?:{D.OBJECT_STOP})[\s\S]*$", ""))


def table_points(phrase: Column) -> Column:
    """The points of a table's phrase; null where it describes no work."""
    words = F.regexp_count(phrase, F.lit("[A-Za-z]{2,}"))
    ok = (words >= 2) & (F.char_length(phrase) >= 10) & ~F.rlike(phrase, F.lit("(?i)" + D.OBJECT_JUNK))
    return F.when(ok, 2.5 + F.least(words, F.lit(12)) / 12 - F.when(words > 40, 1.0).otherwise(0.0))


def table_customer(said: Column) -> Column:
    """Y2: who awards the order, as a table in running text has it; not who it is awarded to."""
    name = F.regexp_extract(_row_of_table(said, D.TABLE_ENTITY + r"(?=.{0,100}?awarding)", 220), r"^(.*?)(?:;|\s\d{1,2}\s*[.)]?(?:\s|$)|\.\s+(?=[A-Z])|$)", 1)
    return scoring.bind(name, lambda n: F.when(F.char_length(n).between(3, 100), n))


def fallback_title(headline: Column, body: Column) -> Column:
    """A filing's own title: a quoted one, what the exchange was informed about, a headline that says something."""
    quoted = lambda x: F.nullif(F.rtrim(F.regexp_extract(x, "(?i)" + D.TITLE_QUOTED, 1)), F.lit(""))
    says = lambda x: ~F.rlike(x, F.lit("(?i)" + D.TITLE_GENERIC)) & ~F.rlike(x, F.lit("(?i)" + D.OBJECT_JUNK))
    told = lambda x: scoring.bind(tidy(F.regexp_extract(x, "(?i)" + D.TITLE_INFORMED, 1)), lambda t: F.when((F.char_length(t) >= 20) & says(t), F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 400))))
    from_head = lambda x: F.when((F.char_length(x) >= 25) & says(x), F.substring(F.regexp_replace(x, r"[ .]+$", ""), 1, 220))
    two = F.struct(text.clean_text(headline).alias("h"), text.clean_text(body).alias("b"))
    return scoring.bind(two, lambda t: F.coalesce(quoted(t["b"]), quoted(t["h"]), told(t["b"]), from_head(t["h"])))


def good_customer(name: Column) -> Column:
    """Whether a name can stand in a description: no parse cut short, no boilerplate."""
    n = F.trim(name)
    count = lambda p: F.regexp_count(n, F.lit(p))
    whole = (count(r"\(") == count(r"\)")) & (count(r"(?:^|\s)'|'(?:\s|$)") % 2 == 0)
    return F.coalesce(F.rlike(n, F.lit("^[A-Z]")) & ~F.rlike(n, F.lit("(?i)" + D.CUSTOMER_JUNK)) & whole & (F.contains(n, F.lit(" ")) | (n == F.upper(n))), F.lit(False))


def _short_customer(n: Column) -> Column:
    """A name (white space squeezed) without its legal form; a very long one by its first part, its acronym or without brackets."""
    long = lambda x: F.char_length(x) > 45
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, "(?i)" + D.LEGAL_TAIL, ""), r"^[ ,.]+|[ ,.]+$", "")
    acronym = lambda x: F.nullif(F.trim(F.regexp_extract(x, r"\(([A-Z][A-Z0-9&.\- ]{2,15})\)", 1)), F.lit(""))
    shorter = lambda x: F.when(long(x), F.coalesce(acronym(x), bare(F.regexp_replace(x, r"(?:\s*\([^()]*\))+\s*$", "")))).otherwise(bare(x))
    return scoring.bind(F.when(long(n), F.substring_index(n, ",", 1)).otherwise(n), shorter)


def fit(x: Column, room: Column) -> Column:
    """A phrase in so many characters: cut at a break that keeps most of it, or between words. `x` and `room` are plain columns."""
    head = F.substring(x, F.lit(1), room + 1)
    part = F.regexp_extract(head, rf"(?s)^(.*){D.PHRASE_BREAKS}", 1)
    cut = scoring.bind(part, lambda p: F.when(F.char_length(p) >= room * 0.6, p).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*) ", 1), F.lit("")), F.substring(x, F.lit(1), room))))
    return F.when(F.char_length(x) <= room, x).otherwise(tidy(cut))


def period_words(months: Column) -> Column:
    """Months as a description has them: days, months or whole years; null for none."""
    n = F.bround(months)
    many = lambda k, unit: F.concat(k.cast("int").cast("string"), F.lit(f" {unit}"), F.when(k == 1, "").otherwise("s"))
    years = F.bround(months / 12)
    return F.when((months < 3) & (F.abs(months - n) > 0.1), many(F.bround(months * 30.44), "day")).when((months >= 12) & (F.abs(months / 12 - years) < 0.01), many(years, "year")).when(months > 0, many(n, "month"))


def summarise(d: DataFrame, what: str, customer: Column, kind: str, value: str, months: str, title: Column, most: int = LONGEST) -> DataFrame:
    """`d` with summary, one sentence: value and kind, from whom, for what, over how long. The object is cut to fit; a customer
    that leaves it under 40 characters goes. Without object and customer the filing's title stands, or nothing.

    What is named more than once is a column of its own, so that no expression is copied.
    """
    noun = F.when(F.col(kind).isin("letter of award", "loa"), "Letter of Award")
    for firmness, name in D.ORDER_NOUNS.items():
        noun = noun.when(F.col(kind).isin(D.FIRMNESS[firmness]), name)
    noun = noun.when(F.col(kind) == "amendment", "change to an order").otherwise("order")
    what_, who, c = F.col(what), F.col("__who"), F.col
    d = d.withColumns({"__name": F.trim(F.regexp_replace(customer, r"\s+", " ")), "__cost": money.short_rupees(c(value)), "__title": title, "__for": F.when(F.startswith(F.lower(what_), F.lit("for ")), " ").otherwise(" for ")})
    d = d.withColumns({"__who": F.when(good_customer(c("__name")), _short_customer(c("__name"))), "__lead": F.concat_ws(" ", "__cost", noun), "__tail": F.concat(F.coalesce(F.concat(F.lit(", over "), period_words(c(months))), F.lit("")), F.lit("."))})
    said = F.when(F.rlike(who, F.lit(r"^(?:A|An|One)\b")), F.concat(F.lower(F.substring(who, 1, 1)), F.substring(who, 2, 200))).otherwise(who)
    d = d.withColumn("__lead", F.concat(F.upper(F.substring("__lead", 1, 1)), F.substring("__lead", 2, 400)))
    d = d.withColumn("__named", F.concat("__lead", F.when(c(kind).isin(D.FIRMNESS[0.40] + D.FIRMNESS[0.30]), " with ").otherwise(" from "), said))
    room = lambda head: F.lit(most) - F.char_length(c(head)) - F.char_length(c("__for")) - F.char_length(c("__tail"))
    d = d.withColumn("__head", F.when(room("__named") >= 40, c("__named")).otherwise(c("__lead"))).withColumn("__room", room("__head"))
    shown = F.contains(c("__title"), F.regexp_extract("__cost", r"([\d,.]+)", 1))
    d = d.withColumn("__figure", F.coalesce(F.when(shown, ""), F.concat(F.lit(" ("), c("__cost"), F.lit(")")), F.lit(""))).withColumn("__title_room", F.lit(most - 1) - F.char_length("__figure"))
    line = F.when(what_.isNotNull(), F.concat(c("__head"), c("__for"), fit(what_, c("__room")), c("__tail"))).when(c("__title").isNotNull(), F.concat(fit(c("__title"), c("__title_room")), c("__figure"), F.lit("."))).when(who.isNotNull(), F.concat(c("__named"), c("__tail")))
    return d.withColumn("summary", line).drop("__name", "__cost", "__title", "__for", "__who", "__lead", "__tail", "__named", "__head", "__room", "__figure", "__title_room")


def scoped(filings: DataFrame) -> DataFrame:
    """`filings` (headline, body, attachment) with scope and stated_customer, from sentences or from a table in the text."""
    d = filings.withColumn("__all", F.concat_ws("\n", "body", "attachment", "headline"))
    d = d.withColumns({"__said": order_scope("headline", "body", "attachment"), "__phrase": table_phrase(F.col("__all")), "stated_customer": table_customer(F.col("__all"))})
    d = d.withColumn("__points", table_points(F.col("__phrase")))
    scope = F.when(F.col("__points") > F.coalesce("__said.points", F.lit(0.0)), F.col("__phrase")).otherwise(F.col("__said.phrase"))
    return d.withColumn("scope", scope).drop("__all", "__said", "__phrase", "__points")


def named(stated: Column, guessed: Column) -> Column:
    """The customer a filing states where that name can stand, else the one read out of its sentences."""
    return F.when(good_customer(stated), stated).otherwise(guessed)


def describe(filings: DataFrame) -> DataFrame:
    """`filings` (headline, body, attachment, customer, order_value_inr, execution_months, order_type) with scope, stated_customer and summary."""
    d = scoped(filings).withColumn("__customer", named(F.col("stated_customer"), F.col("customer")))
    title = F.when(F.col("scope").isNull(), fallback_title(F.col("headline"), F.col("body")))
    return summarise(d, "scope", F.col("__customer"), "order_type", "order_value_inr", "execution_months", title).drop("__customer")


def related_party(said: Column) -> Column:
    """A marker that no question stands before, within 160 characters."""
    question = r"whether|if\s+yes|any\s+of\s+the|does\s+not|not\s+a\b"
    marker = "|".join(re.escape(w) for w in D.RELATED_PARTY)
    found = F.regexp_extract_all(F.lower(said), F.lit(rf"([\s\S]{{0,160}}?)(?:{marker})"), F.lit(1))
    return F.exists(found, lambda lead: ~F.rlike(lead, F.lit(question)))


def evidence(headline: Column, body: Column, attachment: Column, subcategory: Column, statement: Column, table_named: Column, topical: Column, changed: Column) -> Column:
    """struct(received, reason). `topical` and `changed` say whether the filing's titles are about another topic, and whether its lead amends anything."""
    say = lambda ok, why: F.struct(F.lit(ok).alias("received"), why.alias("reason"))
    full, lead = text.joined(headline, body, attachment), text.joined(headline, text.subject(attachment), body)
    changed = changed & F.rlike(lead, F.lit(r"(?i)\b(?:orders?|contracts?|lo[ai])\b"))
    filed_as = F.rlike(F.lower(F.coalesce(subcategory, F.lit(""))), F.lit(text.any_part(D.ORDER_CATEGORIES)))
    return (
        F.when(topical, say(False, F.lit("about another topic")))
        .when(changed, say(True, F.lit("an amendment or cancellation of an order")))
        .when(statement.isNotNull(), say(True, F.concat(F.lit("states "), statement)))
        .when(F.rlike(full, F.lit("(?i)" + D.LOWEST_BIDDER)), say(False, F.lit("lowest bidder only")))
        .when(F.coalesce(table_named, F.lit(False)), say(True, F.lit("the disclosure table names a customer or size")))
        .when(filed_as, say(True, F.lit("filed as an order")))
        .otherwise(say(False, F.lit("no statement of an order received")))
    )


def weighed(filings: DataFrame) -> DataFrame:
    """`filings` with evidence (null where a filing cannot be an order at all), its text and the marks of that, written once."""
    said = lambda c: F.nullif(F.trim(c), F.lit("")).isNotNull() if c in filings.columns else F.lit(False)
    h, b, a, sub = (F.col(c) for c in ("headline", "body", "attachment", "subcategory"))
    d = filings.withColumns({"__full": F.concat_ws("\n", h, b, a), "__head": text.joined(h, F.substring(b, 1, 400))})
    d = d.withColumns({"__marks": scan.marks(F.concat("__full", F.lit(" "))), "__head_marks": scan.order_marks("__head")})
    gate = scan.looks_like_order("__marks") & scan.non_order("__head_marks", "__head").isNull() & ~scan.own_project("__marks")
    d = d.withColumn("__gate", gate)
    d = d.withColumn("__subject", F.when(F.col("__gate"), text.subject(a)))
    can = lambda x: F.when(F.col("__gate"), x)  # noqa: E731  the functions below return at once for null
    d = d.withColumns({"__said": receipt_statement(can(F.col("__full"))), "__topics": scan.word_marks(can(text.joined(sub, h, F.col("__subject")))), "__lead": scan.word_marks(can(text.joined(h, F.col("__subject"), b)))})
    shown = evidence(h, b, a, sub, F.col("__said"), said("t_customer") | said("t_size"), scan.has("__topics", "topic"), scan.has("__lead", "amendment"))
    return cut(d.withColumn("evidence", can(shown)).drop("__head", "__head_marks", "__gate", "__subject", "__said", "__topics", "__lead"), "weighed")


def end_date(said: Column) -> Column:
    """D6."""
    month = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    forms = [(r"\b(\d{1,2}[./-]\d{1,2}[./-]20\d{2})\b", "d-M-y", r"[./]", "-"), (rf"(?i)\b(\d{{1,2}}(?:st|nd|rd|th)?\s+{month}[a-z]*,?\s+20\d{{2}})\b", "d MMM y", rf"(?i)(?<=\d)(?:st|nd|rd|th)|(?<={month})[a-z]+|,", ""), (rf"(?i)\b({month}[a-z]*\s+\d{{1,2}},?\s+20\d{{2}})\b", "MMM d y", rf"(?i)(?<={month})[a-z]+|,", "")]
    found = [F.try_to_timestamp(F.initcap(F.regexp_replace(F.regexp_extract(said, p, 1), wipe, put)), F.lit(f)) for p, f, wipe, put in forms]
    return F.to_date(F.coalesce(*found))


def period_months(answer: Column, filed: Column) -> Column:
    """A table's answer: months of a range's end, the first duration, or to an end date."""
    ranged = calendar._first(answer, rf"(?i)(?:-|–|to)\s*{calendar.SPAN}", True)
    plain = calendar._first(answer, rf"(?i)\b{calendar.SPAN}", True)
    left = F.months_between(end_date(answer), filed)
    return F.coalesce(ranged, plain, F.when((left > 0) & (left <= 240), F.round(left, 1)))


def table_size(answer: Column) -> Column:
    """The order value in a table's answer; a bare figure of two groups counts."""
    fixed = F.regexp_replace(answer, r"(?i)\bR\s+s\.?", "Rs.")
    bare = F.replace(F.regexp_extract(fixed, r"\b(\d{1,3}(?:,\d{2,3}){2,}(?:\.\d+)?)\b", 1), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(money.pick_order_value(fixed)["value_inr"], F.when(bare.between(money.LEAST, money.MOST), bare))


def extract(filings: DataFrame) -> DataFrame:
    """`filings` (headline, body, attachment, subcategory, company_name, filed_at) with the order read from each.

    Answers of the disclosure table (`ANSWERS`), where the filing has such columns, override what the text says.
    """
    table = [c for c in ANSWERS if c in filings.columns]
    h, b, a = (F.col(c) for c in ("headline", "body", "attachment"))
    lead = F.concat_ws("\n", h, b)
    d = weighed(filings)
    yes = d.filter("evidence.received")
    value = F.coalesce(money.pick_order_value(lead), money.pick_order_value(a))
    yes = yes.withColumns({"value": value, "guidance": money.extract_guidance("__full", calendar.fiscal_year(F.col("filed_at")))})
    amended = F.exists("__marks", lambda m: (m["list"] == scan.NUMBER["amendment"]) & (m["stop"] <= F.char_length(lead)))
    kind = scan.order_type("__marks")
    yes = yes.withColumns({
        "is_order": F.lit(True), "order_value_inr": F.col("value.value_inr"), "execution_months": calendar.duration_months(F.col("__full"), F.col("filed_at")),
        "__customer": text.customer(F.col("__full"), F.col("company_name")), "is_amendment": amended, "order_type": F.when(amended, "amendment").otherwise(kind["order_type"]), "firmness": F.when(amended, 0.0).otherwise(kind["firmness"]), "quality_adj": scan.quality_adjustment("__marks"),
    })
    yes = yes.withColumn("__name", scan.word_marks(text.joined(F.col("__customer.name"), F.substring("__full", 1, 40))))
    yes = yes.withColumns({"customer": F.col("__customer.name"), "customer_type": scan.customer_type(F.col("__customer.name"), "__name", "__marks"), "is_related_party": F.coalesce(related_party(F.col("__full")), F.lit(False)) | F.col("__customer.is_self")})
    yes = yes.withColumn("extraction_conf", F.coalesce("value.confidence", F.lit(0.2)))
    yes = scoped(yes).withColumn("customer", named(F.col("stated_customer"), F.col("customer"))).drop("stated_customer")
    yes = apply_table(yes) if table else yes
    # what corroborates the reading: a customer, months, a firm kind of order
    bonus = F.when(F.col("customer").isNotNull(), 0.08).otherwise(0.0) + F.when(F.col("execution_months").isNotNull(), 0.05).otherwise(0.0) + F.when(~F.col("is_amendment") & F.col("order_type").isin(FIRM), 0.05).otherwise(0.0)
    yes = yes.withColumn("extraction_conf", F.least(F.lit(0.95), F.col("extraction_conf") + bonus))
    titled = F.when(F.col("scope").isNull(), fallback_title(h, b))
    yes = summarise(yes, "scope", F.col("customer"), "order_type", "order_value_inr", "execution_months", titled)
    # F8: readings that a second reader should check
    yes = yes.withColumn("needs_check", F.col("order_value_inr").isNull() | (F.col("extraction_conf") < 0.55) | (F.col("execution_months").isNull() & (F.col("order_value_inr") > 5e8)))
    no = d.filter("evidence IS NULL OR NOT evidence.received").withColumn("is_order", F.lit(False))
    return yes.drop("__name").unionByName(no, allowMissingColumns=True).drop("__full", "__marks", "__customer", "value")


#: Phrases of a letter of award or a work order.
FIRM = D.FIRMNESS[1.00]
#: Answers of a disclosure table, as columns of an extracted filing.
ANSWERS = ("t_customer", "t_size", "t_period", "t_related", "t_domestic", "t_nature")


def apply_table(extracted: DataFrame) -> DataFrame:
    """The structured answers override what was guessed; an absent answer changes nothing.

    A table that names a customer, size or period is of an order received: without a known kind it is a work order, of firmness 0.8.

    A value within 2 % of the guess only raises its confidence; a longer scope is not replaced by a shorter one.
    """
    for c in ANSWERS:
        if c not in extracted.columns:
            extracted = extracted.withColumn(c, F.lit(None).cast("string"))
    size, period = table_size(F.col("t_size")), period_months(F.col("t_period"), F.to_date("filed_at"))
    named = text.clean_customer(F.regexp_replace(F.col("t_customer"), r"(?i)^m/s\.?\s*", ""))
    named = F.when(~text.junk_customer(named), named)
    d = extracted.withColumns({"__size": size, "__months": period, "__named": named})
    both = scoring.reconcile(F.col("order_value_inr"), F.col("__size"), F.greatest(F.col("extraction_conf"), F.lit(0.85)))
    d = d.withColumn("__both", both)
    nature = F.nullif(F.trim("t_nature"), F.lit(""))
    d = d.withColumns({
        "order_value_inr": F.when(F.col("__size").isNotNull(), F.col("__both.value")).otherwise(F.col("order_value_inr")),
        "extraction_conf": F.when(F.col("__size").isNotNull(), F.greatest(F.col("__both.confidence"), F.lit(0.85))).otherwise(F.col("extraction_conf")),
        "execution_months": F.coalesce("__months", "execution_months"), "customer": F.coalesce("__named", "customer"),
        "is_related_party": F.coalesce(text.yes_no(F.col("t_related")), F.col("is_related_party")),
        "scope": F.when(F.char_length(nature) > F.char_length(F.coalesce("scope", F.lit(""))), nature).otherwise(F.col("scope")),
    })
    abroad = F.rlike(F.lower("t_domestic"), F.lit(r"\binternational|\bexport|\bforeign|\boverseas"))
    kind = F.when(F.coalesce(abroad, F.lit(False)) & ~F.rlike(F.lower("t_domestic"), F.lit(r"\bdomestic")), "export").when(F.col("__named").isNotNull(), text.customer_type(F.col("customer"), F.lit(""))).otherwise(F.col("customer_type"))
    if {"order_type", "firmness", "is_amendment"} <= set(d.columns):
        said = text.order_type(F.coalesce(nature, F.lit("")))
        order = F.when(said["order_type"] != "unknown", said).when((F.col("order_type") == "unknown") & (F.col("__named").isNotNull() | F.col("__size").isNotNull() | F.col("__months").isNotNull()), F.struct(F.lit("work order").alias("order_type"), F.lit(0.8).alias("firmness")))
        order = F.when(~F.col("is_amendment"), order)
        d = d.withColumn("__order", order).withColumns({"order_type": F.coalesce("__order.order_type", "order_type"), "firmness": F.coalesce("__order.firmness", "firmness")}).drop("__order")
    return d.withColumn("customer_type", kind).drop("__size", "__months", "__named", "__both")


def register(spark) -> None:
    """All text functions under SQL names."""
    money.register(spark)
    for name, f in (("find_order_books", orderbook.find_order_books), ("order_scope", order_scope), ("receipt_statement", receipt_statement)):
        spark.udf.register(name, f)
