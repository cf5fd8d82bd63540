"""Landed files in, normalised filings out (S1-S18, S23, K10). Feeds are fetched elsewhere; here they are JSON and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..config import CRORE
from ..functions.calendar import stale, stamp
from ..functions.markup import annuals, basis, market_cap, number
from ..functions.text import clean_html


def first_filled(*names: str) -> Column:
    """The first of some columns that says something."""
    return F.coalesce(*[F.nullif(F.nullif(F.trim(F.col(n)), F.lit("")), F.lit("-")) for n in names])


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One feed's landed records."""
    return spark.read.schema(schema.NSE_RAW if kind == "NSE" else schema.BSE_RAW).json(path)


def stream_json(spark: SparkSession, path: str, kind: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema.NSE_RAW if kind == "NSE" else schema.BSE_RAW).option("maxFilesPerTrigger", files).json(path)


def nse(raw: DataFrame) -> DataFrame:
    """S5."""
    return raw.select(
        F.lit("NSE").alias("exchange"), first_filled("seq_id", "an_id").alias("native_id"), F.upper(first_filled("symbol")).alias("symbol"), F.lit(None).cast("string").alias("bse_code"),
        first_filled("sm_name", "symbol").alias("company_name"), F.upper(first_filled("sm_isin")).alias("isin"), first_filled("smIndustry").alias("industry"), first_filled("desc").alias("category"), F.lit(None).cast("string").alias("subcategory"),
        first_filled("desc").alias("headline"), clean_html(first_filled("attchmntText")).alias("body"), first_filled("attchmntFile").alias("pdf_url"), stamp(first_filled("an_dt")).alias("filed_at"), stamp(first_filled("exchdisstime", "an_dt")).alias("disseminated_at"),
        F.coalesce("is_sme", F.lit(False)).alias("is_sme"), F.lit(False).alias("targeted"),
    )


def bse(raw: DataFrame, attachments: str = "https://example.invalid/AttachLive/") -> DataFrame:
    """S6."""
    return raw.select(
        F.lit("BSE").alias("exchange"), first_filled("NEWSID").alias("native_id"), F.lit(None).cast("string").alias("symbol"), first_filled("SCRIP_CD").alias("bse_code"),
        first_filled("SLONGNAME").alias("company_name"), F.lit(None).cast("string").alias("isin"), F.lit(None).cast("string").alias("industry"), first_filled("CATEGORYNAME").alias("category"), first_filled("SUBCATNAME").alias("subcategory"),
        clean_html(first_filled("HEADLINE", "NEWSSUB")).alias("headline"), clean_html(first_filled("MORE", "HEADLINE")).alias("body"), F.concat(F.lit(attachments), first_filled("ATTACHMENTNAME")).alias("pdf_url"),
        stamp(first_filled("News_submission_dt", "DT_TM")).alias("filed_at"), stamp(first_filled("DT_TM", "News_submission_dt")).alias("disseminated_at"), F.lit(False).alias("is_sme"), F.coalesce("targeted", F.lit(False)).alias("targeted"),
    )


def keyed(filings: DataFrame) -> DataFrame:
    """The id of a filing from its venue and native id."""
    return filings.withColumn("ann_id", F.sha1(F.concat_ws("|", "exchange", "native_id")))


def once(filings: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row a native id; a targeted feed wins, and its mark is kept. Sorted in so many `tasks`, else in the session's number of partitions."""
    filings = filings.repartition(tasks, "native_id") if tasks else filings
    w = W.partitionBy("exchange", "native_id").orderBy(F.desc("targeted"), "filed_at", "headline")
    return filings.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def manual(spark: SparkSession, path: str) -> DataFrame:
    """Overrides by symbol, code or ISIN; zero means not given; comments are skipped."""
    m = spark.read.schema(schema.MANUAL).csv(path, header=True, comment="#")
    given = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return m.select(F.upper(F.trim("key")).alias("key"), (given("q_revenue_cr") * CRORE).alias("q_revenue_inr"), (given("ttm_revenue_cr") * CRORE).alias("ttm_revenue_inr"), given("ebitda_margin").alias("ebitda_margin"), (given("market_cap_cr") * CRORE).alias("market_cap_inr"), "latest_quarter")


def fundamentals(companies: DataFrame, overrides: DataFrame, *sources: DataFrame, now: Column, days: int = 20) -> DataFrame:
    """An override by symbol, then code, then ISIN; else the first source that is fresh; else the newest stale one."""
    cols = ["q_revenue_inr", "ttm_revenue_inr", "ebitda_margin", "market_cap_inr", "latest_quarter"]
    out = companies
    for k, key in enumerate(("symbol", "bse_code", "isin")):
        side = overrides.select(F.col("key").alias(f"__key{k}"), F.struct(*cols).alias(f"__o{k}")).dropDuplicates([f"__key{k}"])
        out = out.join(side, F.upper(F.col(key)) == F.col(f"__key{k}"), "left").drop(f"__key{k}")
    rated = None
    for k, s in enumerate(sources):
        r = s.select("company_id", "fetched_at", F.struct(*cols).alias("f"), F.lit(k).alias("rank"), stale(F.col("fetched_at"), now, days).alias("stale"))
        rated = r if rated is None else rated.unionByName(r)
    if rated is not None:
        order = F.struct(~F.col("stale"), F.when(~F.col("stale"), -F.col("rank")), F.col("fetched_at"), -F.col("rank"))
        out = out.join(rated.groupBy("company_id").agg(F.max_by("f", order).alias("__s")), "company_id", "left")
    else:
        out = out.withColumn("__s", F.lit(None).cast(f"struct<{','.join(f'{c}:{"string" if c == "latest_quarter" else "double"}' for c in cols)}>"))
    pick = F.coalesce("__o0", "__o1", "__o2", "__s")
    return out.withColumn("__p", pick).select("company_id", *[F.col(f"__p.{c}").alias(c) for c in cols])


def to_refresh(stamps: DataFrame, now: Column, days: int) -> DataFrame:
    """Companies whose page is stale, or was read without a market cap."""
    return stamps.filter(stale(F.col("fetched_at"), now, days) | F.col("market_cap_inr").isNull()).select("company_id")


def sector(known: Column, fresh: Column) -> Column:
    """What the feed says stays; an empty answer is an answer."""
    return F.coalesce(F.nullif(known, F.lit("")), fresh)


def sector_label(x: Column) -> Column:
    """A page's sector as text: entities decoded, white space squeezed, empty as null."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def history_windows(oldest: Column, days: int, step: int = 7) -> Column:
    """Spans of days before the oldest stored filing, to be fetched backwards."""
    ends = F.sequence(F.lit(0), F.lit(days - 1), F.lit(step))
    return F.transform(ends, lambda k: F.struct(F.date_sub(F.to_date(oldest), F.least(k + step, F.lit(days)).cast("int")).alias("from"), F.date_sub(F.to_date(oldest), (k + 1).cast("int")).alias("to")))


def pdf_files(spark: SparkSession, path: str, most_mb: float = 12.0) -> DataFrame:
    """Landed attachments that are PDFs, by the sha1 of their address in the file name."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return f.filter((F.col("length") <= int(most_mb * 1e6)) & F.startswith("content", F.lit(b"%PDF"))).select(F.regexp_extract("path", r"([0-9a-f]{40})\.pdf$", 1).alias("key"), "content")


#: Names under which the landed results of a quarter give one figure, first to last: fixed values.
RESULTS = {
    "revenue": ("income", "re_income", "totalIncome", "revenue", "incomeFromOperations", "net_sales"), "pbt": ("proLossBefTax", "reProLossBefTax", "pbt"), "pat": ("proLossAftTax", "reProLossAftTax", "net_prof", "pat"),
    "expenditure": ("exp", "expenditure", "re_exp"),
}
RESULT_ENDS = ("to_date", "re_to_date", "toDate", "quarter_ended")


def results(raw: DataFrame) -> DataFrame:
    """Landed quarterly results (company_id, position, newest first, and any of the names above, as text in lakhs) in rupees.

    Quarters without revenue are left out; a figure that is no number counts as missing.
    """
    has = lambda names: [n for n in names if n in raw.columns]
    figure = lambda names: F.coalesce(*[number(F.col(n).cast("string")) for n in has(names)], F.lit(None).cast("double")) * 1e5
    end = first_filled(*has(RESULT_ENDS)) if has(RESULT_ENDS) else F.lit(None).cast("string")
    return raw.select("company_id", "position", end.alias("quarter"), *[figure(names).alias(k) for k, names in RESULTS.items()]).filter(F.col("revenue").isNotNull())


def metrics(quarters: DataFrame, source: Column, confidence: Column | None = None) -> DataFrame:
    """One row a company of its newest eight quarters (company_id, position, quarter, revenue, expenditure, pat): the
    latest quarter, the sums of four and of the four before, growth on the year, margins, how sure it is."""
    nth = quarters.withColumn("k", F.row_number().over(W.partitionBy("company_id").orderBy("position"))).filter("k <= 8")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    four = lambda a, n: F.when(F.count("*") >= n, F.sum(F.when(F.col("k").between(a, a + 3), F.col("revenue"))))
    m = nth.groupBy("company_id").agg(at("quarter", 1).alias("latest_quarter"), at("revenue", 1).alias("q_revenue_inr"), four(1, 4).alias("ttm_revenue_inr"), four(5, 8).alias("prev_ttm_revenue_inr"), at("expenditure", 1).alias("__exp"), at("pat", 1).alias("__pat"), at("revenue", 5).alias("__ago"))
    some = lambda n: F.nullif(F.col(n), F.lit(0.0))
    m = m.withColumns({"ebitda_margin": 1 - some("__exp") / some("q_revenue_inr"), "net_margin": some("__pat") / some("q_revenue_inr"), "q_revenue_yoy": F.col("q_revenue_inr") / some("__ago") - 1})
    sure = F.when(F.col("ttm_revenue_inr").isNotNull() & (F.col("ttm_revenue_inr") != 0), 0.9).otherwise(0.65) if confidence is None else confidence
    return m.withColumns({"source": source, "confidence": sure}).drop("__exp", "__pat", "__ago")


#: Names of revenue in the second vendor's statements, first to last: fixed values.
VENDOR_REVENUE = ("total revenue", "operating revenue", "revenue")
VENDOR_EARNINGS = ("ebitda", "normalized ebitda")


def vendor(statements: DataFrame, companies: DataFrame) -> DataFrame:
    """The same metrics from landed statements (ticker, item, quarter as a date, amount) by the venue's tickers.

    A company's symbol with .NS is tried first, then its code with .BO: the first that has revenue is taken. Of the names of
    revenue the first in the list that the ticker has counts. The margin is its earnings over the revenue of its latest quarter.
    """
    rank = lambda names: F.when(F.col("item").isin(*names), F.array_position(F.array(*map(F.lit, names)), F.col("item")))
    s = statements.filter(F.col("amount").isNotNull()).withColumn("item", F.lower("item"))

    def best(names: tuple[str, ...]) -> DataFrame:
        first = s.withColumn("__r", rank(names)).filter(F.col("__r").isNotNull())
        return first.withColumn("__least", F.min("__r").over(W.partitionBy("ticker"))).filter("__r = __least").select("ticker", "quarter", "amount")

    tickers = companies.select("company_id", F.posexplode(F.array(F.concat("symbol", F.lit(".NS")), F.concat("bse_code", F.lit(".BO")))).alias("turn", "ticker")).filter(F.col("ticker").isNotNull())
    had = tickers.join(best(VENDOR_REVENUE), "ticker").withColumn("__first", F.min("turn").over(W.partitionBy("company_id"))).filter("turn = __first")
    earned = best(VENDOR_EARNINGS).groupBy("ticker").agg(F.max_by("amount", "quarter").alias("__earned"))
    q = had.select("company_id", "ticker", F.col("quarter").cast("string").alias("quarter"), F.col("amount").alias("revenue"), (-F.unix_date(F.col("quarter").cast("date"))).alias("position"), F.lit(None).cast("double").alias("expenditure"), F.lit(None).cast("double").alias("pat"))
    own = had.select("company_id", "ticker").distinct()
    m = metrics(q, F.lit(None).cast("string"), F.lit(0.7)).drop("source").join(own, "company_id").join(earned, "ticker", "left")
    return m.withColumns({"ebitda_margin": F.col("__earned") / F.nullif(F.col("q_revenue_inr"), F.lit(0.0)), "source": F.concat(F.lit("vendor:"), "ticker")}).drop("__earned", "ticker")


def company_pages(consolidated: DataFrame, standalone: DataFrame) -> DataFrame:
    """Of two landed pages a company (company_id, page) the market cap of the first that is there, and the last year of the first with sales."""
    both = consolidated.withColumn("turn", F.lit(0)).unionByName(standalone.withColumn("turn", F.lit(1))).filter(F.col("page").isNotNull())
    done = F.filter(annuals(F.col("page")), lambda y: F.coalesce(y["sales"], F.lit(0.0)) != 0)
    p = both.select("company_id", "turn", market_cap(F.col("page")).alias("cap"), basis(F.col("page")).alias("basis"), F.array_max(F.transform(done, lambda y: F.struct(y["fy"].alias("fy"), y["sales"].alias("sales")))).alias("year"))
    first = p.groupBy("company_id").agg(F.min_by(F.struct("cap"), "turn").alias("c"), F.min_by(F.struct("year", "basis"), F.when(F.col("year").isNotNull(), F.col("turn"))).alias("y"))
    return first.select("company_id", F.col("c.cap").alias("market_cap_inr"), F.col("y.year.fy").alias("last_fy"), F.col("y.year.sales").alias("last_fy_revenue_inr"), F.when(F.col("y.year").isNotNull(), F.col("y.basis")).alias("revenue_basis"))
