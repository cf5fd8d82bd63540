"""Verdicts on headlines that say an order was won by various verbs."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import filing, text

#: (headline, whether it looks like an order, whether it states that one was received)
HEADLINES = [
    ("Company bags order worth Rs 40 crore", True, True), ("Bags contract for two bridges", True, True), ("Company has secured an order for pumps", True, True), ("Wins orders for smart meters from three utilities", True, True),
    ("Has won a work order", True, True), ("Received letter of award for a depot", True, True), ("Receipt of order", True, True), ("Bagging/Receiving of orders/contracts", True, False), ("Secures project in Nagpur", True, False),
    ("Lands tender for track renewal", True, False), ("Board meeting on Friday", False, False), ("The bag maker opens a plant", False, False), ("Appointment of a director", False, False), ("Order passed by a court", False, False),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    d = spark.createDataFrame([(h,) for h, *_ in HEADLINES], "h string")
    return {r.h: (r.like, r.got) for r in d.select("h", text.looks_like_order(F.col("h")).alias("like"), filing.receipt_statement("h").isNotNull().alias("got")).collect()}


@pytest.mark.parametrize("headline, like, got", HEADLINES)
def test_verdict(verdicts, headline, like, got):
    assert verdicts[headline] == (like, got)
