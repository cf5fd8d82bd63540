"""Company identity across venues (J13, TR14, S18, Appendix A `_company_id`, `_merge_company`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import company_key
from .components import components


def mint(isin: Column, symbol: Column, code: Column, name: Column) -> Column:
    """An id from the best identifier at hand."""
    filled = lambda x: F.nullif(F.upper(F.trim(x)), F.lit(""))
    return F.coalesce(filled(isin), F.concat(F.lit("NSE:"), filled(symbol)), F.concat(F.lit("BSE:"), filled(code)), F.concat(F.lit("NAME:"), F.substring(F.sha1(F.coalesce(name, F.lit(""))), 1, 12)))


def ranked(isin: Column, symbol: Column, code: Column, name: Column) -> Column:
    """struct(rank, id): the id that `mint` gives, after the kind of identifier: ISIN, symbol, code, name."""
    filled = lambda x: F.nullif(F.trim(x), F.lit("")).isNotNull()
    rank = F.when(filled(isin), 0).when(filled(symbol), 1).when(filled(code), 2).otherwise(3)
    return F.struct(rank.alias("rank"), mint(isin, symbol, code, name).alias("id"))


def _closed(pairs: DataFrame) -> DataFrame:
    """Rows (isin, key, best): the best-ranked id among all rows that are joined by equal ISINs and equal keys.

    ISINs and keys are the nodes, rows with both the edges; the rounds grow with the logarithm of a chain's length.
    """
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    edges = pairs.filter("isin IS NOT NULL AND key IS NOT NULL").select(node("i", "isin").alias("a"), node("k", "key").alias("b"))
    of = components(edges)
    own = F.coalesce(node("i", "isin"), node("k", "key"))
    pairs = pairs.withColumn("node", own).join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = pairs.filter("component IS NOT NULL").groupBy("component").agg(F.min("best").alias("least"))
    return pairs.join(best, "component", "left").select("isin", "key", F.coalesce("least", "best").alias("best"))


def resolve(filings: DataFrame, companies: DataFrame, least_key: int = 6) -> DataFrame:
    """`filings` with company_id: the known company of the ISIN, else of the normalised name, else one id for all filings of
    the batch that are joined by ISIN or name, however many steps apart: a known one of any of them, else the best minted.

    ISINs rank before symbols, codes and names. Two ISINs under one name are one company, of the smaller ISIN, unless both are
    known already: a new ISIN under a known name is taken for another listing of that company. Names of under `least_key`
    letters join nothing.
    """
    key = company_key(F.col("company_name"))
    f = filings.withColumn("__isin", F.nullif(F.upper(F.trim("isin")), F.lit(""))).withColumn("__key", F.when(F.char_length(key) >= least_key, key))
    known = companies.select(F.nullif(F.upper(F.trim("isin")), F.lit("")).alias("__isin"), company_key(F.col("company_name")).alias("__key"), "company_id")
    by_isin = known.filter("__isin IS NOT NULL").groupBy("__isin").agg(F.min("company_id").alias("__by_isin"))
    by_name = known.filter(F.char_length("__key") >= least_key).groupBy("__key").agg(F.min("company_id").alias("__by_name"))
    f = f.join(by_isin, "__isin", "left").join(by_name, "__key", "left").withColumn("__own", F.coalesce("__by_isin", "__by_name"))
    minted = ranked(F.col("isin"), F.col("symbol"), F.col("bse_code"), F.col("company_name"))
    best = F.when(F.col("__own").isNotNull(), F.struct(F.lit(-1).alias("rank"), F.col("__own").alias("id"))).otherwise(minted)
    f = f.withColumn("__best", best)
    pairs = f.groupBy(F.col("__isin").alias("isin"), F.col("__key").alias("key")).agg(F.min("__best").alias("best"))
    pairs = _closed(pairs).select(F.coalesce("isin", F.lit("")).alias("__i"), F.coalesce("key", F.lit("")).alias("__k"), F.col("best.id").alias("__joined")).filter("__i <> '' OR __k <> ''")
    f = f.withColumn("__i", F.coalesce("__isin", F.lit(""))).withColumn("__k", F.coalesce("__key", F.lit("")))
    return f.join(pairs, ["__i", "__k"], "left").select(*filings.columns, F.coalesce("__own", "__joined", "__best.id").alias("company_id"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Company rows overlaid: identifiers once known stay known, `is_sme` is only ever set, a sector is not blanked."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    last = lambda c: F.max_by(F.col(c), F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.col("__v"))).alias(c)
    cols = [c for c in both.columns if c not in ("company_id", "__v", "is_sme")]
    sme = [F.coalesce(F.bool_or("is_sme"), F.lit(False)).alias("is_sme")] if "is_sme" in both.columns else []
    return both.groupBy("company_id").agg(*[last(c) for c in cols], *sme)
