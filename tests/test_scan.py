"""The automaton against the list-by-list expressions of `text`: the same verdicts, over all lists."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import dictionaries as D
from tidemark.functions import scan, text

#: Words and pattern fillers that the lists are mixed with.
FILL = ["the company", "of", "for", "worth Rs 4 crore", "Limited", "and", "s", "es", "-", ".", "\n", "x1", "(", "setting up", "Receives", "won 3", "order", "contracts", "ratings", "İstanbul", "₹", "passed by the hon", "estimated capital expenditure", "own plant", "funded by debt"]


def texts():
    r = random.Random(8)
    every = [w for _, words in scan.LISTS.values() for w in words]
    out = [None, "", " "]
    for w in every:  # each word alone, as a part of a word, with endings, in capitals
        out += [w, f"x{w}", f"{w}x", f"{w}s", f"{w}es", f"{w}ess", w.upper(), f"é{w}é", f"({w})", f"9{w}"]
    for _ in range(1500):
        parts = [r.choice(every) if r.random() < 0.4 else r.choice(FILL) for _ in range(r.randrange(1, 12))]
        out.append(r.choice([" ", "", "\n", "  "]).join(parts))
    return out


@pytest.fixture(scope="module")
def both(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "k int, t string").repartition(8)
    t, none = F.col("t"), F.lit("")
    old = {
        "order": text.looks_like_order(t), "non_order": text.non_order(t), "probe": text.worth_probe(t, none), "own": F.coalesce(text.own_project(t), F.lit(False)), "kind": text.order_type(t), "amended": text.amendment(t),
        "quality": text.quality_adjustment(t), "topic": text.not_order_topic(t), "buyer": text.customer_type(F.lit(None).cast("string"), t), "book": text.mentions_book(t),
    }
    d = d.withColumns({"m": scan.marks(t), "m2": scan.marks(F.concat_ws(" ", t, none)), "m3": scan.marks(F.concat(F.lower(text.joined(F.lit(None).cast("string"), t)), F.lit(" ")))})
    new = {
        "order": scan.looks_like_order("m"), "non_order": scan.non_order("m", "coalesce(t, '')"), "probe": scan.worth_probe("m2"), "own": scan.own_project("m"), "kind": scan.order_type("m"), "amended": scan.has("m", "amendment"),
        "quality": scan.quality_adjustment("m"), "topic": scan.has("m", "topic"), "buyer": scan.customer_type(F.lit(None).cast("string"), "m3"), "book": scan.has("m", "book"),
    }
    return d.select("k", "t", *[c.alias(f"old_{n}") for n, c in old.items()], *[c.alias(f"new_{n}") for n, c in new.items()]).collect()


@pytest.mark.parametrize("rule", ["order", "non_order", "probe", "own", "kind", "amended", "quality", "topic", "buyer", "book"])
def test_same_verdict(both, rule):
    # patterns take letters past ASCII as letters, which the JVM does for the ends of words only
    patterned = rule in ("order", "non_order", "probe", "own")
    said = [(r.t, r[f"old_{rule}"], r[f"new_{rule}"]) for r in both if not (patterned and r.t and not r.t.isascii())]
    differ = [x for x in said if x[1] != x[2] and not (x[0] is None and not x[2])]
    assert not differ, differ[:3]
    assert len({str(x[1]) for x in said}) > 1


def test_marks_are_first_places():
    low = "work orders and a work order; export order"
    found = {(k, w): (s, e) for k, w, s, e in scan.find(low)}
    number = scan.NUMBER["kind"], [w for words in D.FIRMNESS.values() for w in words].index("work order")
    assert found[number] == (0, 10) and scan.find(None) == [] and scan.find("") == []
