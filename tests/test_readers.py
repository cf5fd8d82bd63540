"""Readers: gates and kept readings change no result."""

import re
from datetime import date

from tidemark.functions import filing, money, orderbook, scan


def test_patterns_are_gated_by_what_they_must_hold():
    assert scan.sure(r"\bexpansion of (?:its|our)\b") == "expansion of "
    assert scan.sure(r"\borders?\s+(?:book)\b") == "order"
    assert scan.sure("won|lost") == ""
    said = "A CAPEX OF Rs 5 crore is funded through debt; Order book stands. Estimated capital expenditure; for ſetting up own plant"
    free = {(scan.NUMBER[n], k) for n, (patterns, need) in scan.PATTERNS.items() for k, p in enumerate(patterns) if any(w in said.lower() for w in need) and re.search(p, said.lower(), re.I)}
    assert free and {m[:2] for m in scan.find(said) if m[0] >= scan.NUMBER["order_pattern"]} == free


def test_the_same_text_is_read_once(monkeypatch):
    said = "We have received a work order worth Rs 7,654 crore."
    first = money.order_value(said)
    monkeypatch.setattr(money, "amounts", lambda *_: 1 / 0)
    assert money.order_value(said) is first and first.value_inr == 7654e7
    assert filing.receipt(said) == filing.receipt(said)


def test_dates_are_left_out_with_and_without_digits():
    assert orderbook.without_dates("at March end, as of FY25 and 31.03.2025") == "at  , as of   and  "
    assert orderbook.without_dates("at March end") == "at  "
    assert orderbook.without_dates("no date") == "no date"
    s = orderbook.Sentence("Order book of Rs 500 crore at Q2 FY25, and at Dec end", date(2025, 1, 5))
    assert [d.day for d in s.days] == [date(2024, 9, 30), date(2024, 12, 31)]
