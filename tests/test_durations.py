"""Durations: looks ahead and single searches change no result."""

import re

from pyspark.sql import functions as F

from tidemark import dictionaries as D
from tidemark.functions import calendar


def test_a_duration_is_searched_once(spark):
    d = spark.createDataFrame([("within 18 months",), ("over half year",), ("within 300 years, then over 2 weeks",), ("by and by",)], "t string")
    months = calendar._first(F.col("t"), rf"(?i){calendar.LEAD}\s*{calendar.SPAN}", True)
    out = d.select("t", months.alias("m"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2
    assert [r.m for r in out.collect()] == [18.0, 6.0, 2 / 4.33, None]


def test_leads_and_words_begin_as_the_looks_ahead_say():
    for lead in ("with", "within", "over", "period of", "completion time of", "execution period of", "executed in", "spread over", "duration of", "tenure of", "completed within", "to be executed in", "stipulated period of", "delivery schedule is for", "operational within", "initially", "valid for", "term of", "for a period of", "purchase orders is for", "contract is for", "orders is for"):
        assert re.fullmatch(D.DURATION_LEADS, lead, re.I) and re.fullmatch(calendar.LEAD, lead, re.I)
    assert all(re.fullmatch(calendar.TOKEN, w, re.I) for w in [*D.NUMBER_WORDS, "12", "1.5"])
