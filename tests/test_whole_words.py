"""Whole words are searched only where the word is."""

from pyspark.sql import functions as F

from tidemark import dictionaries as D
from tidemark.functions import text


def test_whole_words_are_searched_where_the_word_is(spark):
    d = spark.createDataFrame([("An L1 bidder by Road.",), ("broad roads, l10",), ("",), (None,)], "t string")
    out = d.select(F.round(text.quality_adjustment(F.col("t")), 6).alias("p"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Contains(") >= len(D.QUALITY_BUMPS) + len(D.QUALITY_DINGS)
    assert [r.p for r in out.collect()] == [round(D.QUALITY_DINGS["l1"] + D.QUALITY_DINGS["road"], 6), 0.0, 0.0, 0.0]
