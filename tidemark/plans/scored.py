"""Scoring queries: filings with point-in-time fundamentals and history, scored and tiered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, scoring
from ..functions.calendar import duration_months
from ..operators import sequences
from ..shared import cut
from . import base


def _with_fundamentals(f: DataFrame) -> DataFrame:
    """S10 point in time: revenue of the quarter before a filing's own, and of the four before, from one window by company."""
    q = F.year("filed_at") * 4 + F.quarter("filed_at")
    f = f.withColumn("q", q.cast("long"))
    w = W.partitionBy("company_id").orderBy("q")
    cents = F.bround(F.col("order_value_inr") / 1e3).cast("long")
    q1, q4 = (F.sum(cents).over(w.rangeBetween(-n, -1)) for n in (1, 4))
    return f.withColumn("q_revenue_inr", q1 * 1e3).withColumn("ttm_revenue_inr", q4 * 1e3)


def scored(spark: SparkSession, sf_dir: str, *, exact: bool = False) -> DataFrame:
    f = base.filings(spark, sf_dir, heavy=True).join(base.companies(spark, sf_dir), "company_id")
    f = f.withColumn("text", base.filing_text()).drop("order_value_inr", "execution_months")
    f = f.withColumn("order_value_inr", F.bround(money.simple_value(F.col("text")))).withColumn("execution_months", duration_months(F.col("text"), F.col("filed_at")))
    # what is read out of text is written once, as the silver table it belongs in: every later expression names columns of it
    f = cut(f.drop("text"), "silver")
    f = sequences.novelty_history(_with_fundamentals(f))
    f = f.withColumns({
        "ebitda_margin": F.when(F.col("balance") > 0, F.col("balance") / 40000), "market_cap_inr": F.when(F.col("company_id") % 2 == 0, F.col("company_id") * 1e8),
        "is_sme": F.col("company_id") % 5 == 0, "is_related_party": F.col("order_id") % 17 == 0, "extraction_conf": (F.col("order_id") % 10) / 10,
        "seen_at": F.timestamp_add("HOUR", (F.col("order_id") % 60).cast("int"), F.col("filed_at")),
    })
    return scoring.score(f, exact=exact)


def score_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir, exact=True)
    return s.select("order_id", scoring.half_up(F.col("score"), 1).alias("score"), "tier", "data_quality", "implausible")


def flagship(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    """The best orders: extracted, enriched, scored."""
    s = scored(spark, sf_dir).select("order_id", "company_name", "order_value_inr", "execution_months", "score", "tier", "data_quality")
    return s.orderBy(F.desc("score"), "order_id").limit(n)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select("order_id", *[F.round(c, 6).alias(c) for c in ("f_annualised", "f_quarterly", "f_firmness", "f_margin", "f_novelty", "f_capacity", "gate", "p_mcap", "p_related", "p_stale")])


def log_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = base.filings(spark, sf_dir)
    return f.select("order_id", F.round(scoring.log_curve(F.col("order_value_inr") / 2e10, 0.1, 3.0), 6).alias("curve"))


def tier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir, exact=True)
    return s.groupBy("tier").agg(F.count("*").alias("n"), F.count_distinct("company_id").alias("companies"))


def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sequences.novelty_history(base.filings(spark, sf_dir))
    return f.select("order_id", F.round("history_median", 1).alias("history_median"), "history_n")


_CURVE = "CASE WHEN {x} IS NULL OR {x} <= {lo} THEN 0.0 WHEN {x} >= {hi} THEN 1.0 ELSE ln({x} / {lo}) / ln({hi} / {lo}) END"


def _curve(x: str, lo: str, hi: str) -> str:
    return _CURVE.format(x=x, lo=f"{lo}::DOUBLE", hi=f"{hi}::DOUBLE")


_HISTORY = """h AS (SELECT a.order_id, median(b.order_value_inr) AS history_median, count(b.order_value_inr) AS history_n FROM f a LEFT JOIN f b ON a.company_id = b.company_id AND NOT b.is_amendment AND b.order_value_inr > 0
 AND b.filed_at < a.filed_at AND b.filed_at >= a.filed_at - INTERVAL 720 DAY GROUP BY a.order_id)"""
_SCORED = f"""WITH {base.FILINGS.replace("o_totalprice * 1e5", "round(o_totalprice * 1e5)")}, {_HISTORY},
 q AS (SELECT company_id, year(filed_at) * 4 + quarter(filed_at) AS q, sum(CAST(round(order_value_inr / 1e3) AS BIGINT)) AS v FROM f GROUP BY ALL),
 r AS (SELECT f.order_id, sum(CASE WHEN q.q >= year(filed_at) * 4 + quarter(filed_at) - 1 THEN q.v END) * 1e3::DOUBLE AS qr, sum(q.v) * 1e3::DOUBLE AS ttm
  FROM f LEFT JOIN q ON q.company_id = f.company_id AND q.q BETWEEN year(filed_at) * 4 + quarter(filed_at) - 4 AND year(filed_at) * 4 + quarter(filed_at) - 1 GROUP BY f.order_id),
 i AS (SELECT f.*, qr, coalesce(ttm, qr * 4) AS ttm, history_median AS med, history_n AS hn, CASE WHEN c_acctbal > 0 THEN c_acctbal / 40000 END AS margin, CASE WHEN company_id % 2 = 0 AND company_id > 0 THEN company_id * 1e8::DOUBLE END AS mcap,
  company_id % 5 = 0 AS sme, order_id % 17 = 0 AS rel, (order_id % 10) / 10.0::DOUBLE AS conf0, order_id % 60 > 48 AS stale FROM f JOIN customer ON c_custkey = company_id JOIN h USING (order_id) JOIN r USING (order_id)),
 j AS (SELECT *, order_value_inr / (greatest(3.0::DOUBLE, least(120.0::DOUBLE, execution_months)) / 12) / ttm AS ra, order_value_inr / qr AS rq, CASE WHEN conf0 = 0 THEN 0.6 ELSE conf0 END AS conf FROM i),
 k AS (SELECT *, {_curve("ra", "0.01", "0.60")} AS f_annualised, {_curve("rq", "0.10", "3.00")} AS f_quarterly, CASE WHEN is_amendment THEN 0.0 ELSE firmness END AS f_firmness,
  coalesce(greatest(0.0, least(1.0, margin / 0.25::DOUBLE)), 0.45) AS f_margin,
  CASE WHEN hn = 0 THEN 0.9 WHEN med <= 0 THEN 0.7 ELSE ({_curve("(order_value_inr / med)", "0.5", "5.0")}) * CASE WHEN hn >= 12 THEN 0.85::DOUBLE ELSE 1 END END AS f_novelty,
  CASE WHEN ttm > 0 THEN CASE WHEN order_value_inr / ttm <= 1 THEN 1.0 WHEN order_value_inr / ttm <= 3 THEN 0.7 WHEN order_value_inr / ttm <= 10 THEN 0.35 ELSE 0.10 END ELSE 0.6 END AS f_capacity,
  coalesce(greatest(CASE WHEN ra IS NOT NULL THEN {_curve("ra", "0.02", "0.10")} END, CASE WHEN rq IS NOT NULL THEN {_curve("rq", "0.10", "0.50")} END), 0.25) AS gate,
  CASE WHEN order_value_inr / mcap > 5 THEN 0.40 WHEN sme AND order_value_inr / mcap > 2 THEN 0.60 ELSE 1.0 END AS p_mcap, CASE WHEN rel THEN 0.50 ELSE 1.0 END AS p_related, CASE WHEN stale THEN 0.70 ELSE 1.0 END AS p_stale, coalesce(rq > 25, false) AS implausible FROM j),
 l AS (SELECT *, ((f_annualised * 40 + f_quarterly * 20) * (0.55::DOUBLE + 0.45::DOUBLE * f_firmness) + (f_firmness * 15 + f_margin * 10 + f_novelty * 10 + f_capacity * 5) * gate) * p_mcap * p_related * CASE WHEN implausible THEN 0.35::DOUBLE ELSE 1 END * CASE WHEN conf < 0.6 THEN 0.7::DOUBLE + 0.5::DOUBLE * conf ELSE 1 END AS raw FROM k),
 m AS (SELECT *, least(least(raw, CASE WHEN ttm IS NULL THEN 60 ELSE 1000 END, CASE WHEN is_amendment THEN 25 ELSE 1000 END, CASE WHEN implausible THEN 40 ELSE 1000 END) * p_stale, CASE WHEN is_amendment THEN 25 ELSE 100 END) AS s FROM l),
 n AS (SELECT *, CASE WHEN order_value_inr < 1e7 THEN 'STORE' WHEN s >= 75 THEN CASE WHEN f_firmness < 0.5 THEN 'MEDIUM' ELSE 'HIGH' END WHEN s >= 60 THEN 'MEDIUM' WHEN s >= 40 THEN 'WATCH' ELSE 'STORE' END AS t FROM m),
 z AS (SELECT *, CASE WHEN t IN ('WATCH', 'STORE') AND p_mcap = 1 AND p_related = 1 AND p_stale = 1 AND NOT implausible AND coalesce(rq >= 0.5, false) AND order_value_inr >= 1e7 AND NOT is_amendment THEN 'MEDIUM' ELSE t END AS tier FROM n)
"""

QUERIES = {"score_tiers": score_tiers, "score_components": components, "score_log_curve": log_curves, "score_tier_stats": tier_stats, "novelty_point_in_time": novelty}
ORACLES = {
    "score_tiers": _SCORED + "SELECT order_id, round(round(s, 2), 1) AS score, tier, CASE WHEN ttm IS NULL OR implausible THEN 'low' ELSE 'good' END AS data_quality, implausible FROM z",
    "score_components": _SCORED + "SELECT order_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("f_annualised", "f_quarterly", "f_firmness", "f_margin", "f_novelty", "f_capacity", "gate", "p_mcap", "p_related", "p_stale")) + " FROM z",
    "score_log_curve": f"WITH {base.FILINGS} SELECT order_id, round({_curve('(order_value_inr / 2e10)', '0.1', '3.0')}, 6) AS curve FROM f",
    "score_tier_stats": _SCORED + "SELECT tier, count(*) AS n, count(DISTINCT company_id) AS companies FROM z GROUP BY tier",
    "novelty_point_in_time": f"WITH {base.FILINGS}, {_HISTORY} SELECT order_id, round(history_median, 1) AS history_median, history_n FROM h",
}
