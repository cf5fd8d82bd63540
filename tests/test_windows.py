"""Trailing medians, carried values, components and collapse against brute force, and their growth for one hot company."""

import random
import statistics
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import components, entity, sequences, views, windows

DAY = 86400


def orders(spark, rows):
    """(company, order, seconds or None, value, is_amendment, kind, exchange)"""
    at = lambda s: None if s is None else datetime(2020, 1, 1) + timedelta(seconds=s)
    data = [(c, o, at(s), v, am, kind, ex, m, sc) for c, o, s, v, am, kind, ex, m, sc in rows]
    return spark.createDataFrame(data, "company_id int, order_id long, filed_at timestamp, order_value_inr double, is_amendment boolean, order_type string, exchange string, execution_months double, score double")


def some(seed, n, companies=3, days=2000):
    r = random.Random(seed)
    out = []
    for k in range(n):
        s = None if r.random() < 0.02 else r.choice([r.randrange(days) * DAY, r.randrange(days * DAY), 700 * DAY, 720 * DAY, 0])
        v = r.choice([None, 0.0, -5.0, 100.0, 100.0, 100.4, 1e9, 1.004e9, r.random() * 1e9, float(r.randrange(5)) * 1e7])
        out.append((r.choice([None, *range(companies)]), k, s, v, r.choice([None, False, False, True]), r.choice([None, "a", "b"]), r.choice(["NSE", "BSE"]), r.choice([None, 6.0]), r.choice([None, 1.0, 2.0])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_median(spark, monkeypatch, seed):
    data = some(seed, 400)
    monkeypatch.setattr(windows, "PASS", 50)
    got = {r.order_id: (r.history_median, r.history_n) for r in sequences.novelty_history(orders(spark, data).repartition(5)).collect()}
    for c, o, s, *_ in data:
        h = [v for c2, _, s2, v, am, *_ in data if c2 == c and s is not None and s2 is not None and s - 720 * DAY <= s2 < s and v is not None and v > 0 and not am]
        assert got[o] == (statistics.median(h) if h else None, len(h)), o


def test_kth_of_ranges():
    r = np.random.default_rng(4)
    v = r.integers(0, 30, 500).astype(float)
    low = r.integers(0, 499, 400)
    high = low + 1 + r.integers(0, 500 - low)
    k = r.integers(0, high - low)
    want = [np.sort(v[a:b])[i] for a, b, i in zip(low, high, k)]
    assert windows.kth(v, low, high, k).tolist() == want
    assert windows.kth(np.array([7.0]), np.array([0]), np.array([1]), np.array([0])).tolist() == [7.0]


def test_median_of_a_hot_company_grows_with_its_rows():
    """10^5 filings of one company, an hour apart: the work on a cell grows with a power of 1.1 at most."""
    took = {}
    for n in (25_000, 100_000):
        at = np.arange(n) * 3600
        value = np.random.default_rng(n).random(n)
        every = np.ones(n, bool)
        best = 9e9
        for _ in range(3):
            t = time.process_time()
            windows.medians(np.zeros(n, np.int64), at, value, every, every, 720 * DAY)
            best = min(best, time.process_time() - t)
        took[n] = best
    # n log n from 25,000 to 100,000 is a power of 1.09; a little is left for the clock
    assert took[100_000] < 4**1.25 * took[25_000], took


def test_a_company_of_years_is_many_tasks(spark):
    rows = [(7, k, k * 36 * 3600, float(k % 50 + 1), False, "a", "NSE", 6.0, 1.0) for k in range(3000)]
    d = orders(spark, rows)
    plan = d.transform(lambda x: sequences.novelty_history(x))
    assert "__cell" in plan._jdf.queryExecution().toString()
    got = {r.order_id: r.history_n for r in plan.collect()}
    assert all(got[k] == min(k, 480) for k in range(3000))


@pytest.mark.parametrize("hot", [None, 5])
def test_as_of_with_a_hot_company(spark, hot):
    r = random.Random(11)
    left = [(k, r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *range(2000, 2012)])) for k in range(600)]
    right = [(r.choice(["hot", "hot", "a", None]), r.choice([None, *range(1995, 2012)]), float(r.randrange(100))) for _ in range(80)]
    got = {x.n: (x.fy, x.v) for x in views.as_of(spark.createDataFrame(left, "n int, key string, want int").repartition(7), spark.createDataFrame(right, "key string, fy int, v double"), "key", F.col("want"), "fy", ["v"], hot=hot).collect()}
    for n, key, want in left:
        have = [(y, v) for k, y, v in right if k == key and key is not None and y is not None and want is not None and y <= want]
        assert got[n] == (max(have) if have else (None, None)), (n, key, want)
    assert len(got) == len(left)


def test_a_hot_key_is_dealt_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), (F.col("id") % 4000).cast("int").alias("y"), F.when(F.col("id") == 3, F.struct(F.lit(1).alias("v"))).alias("r"))
    out = windows.last_before(rows.repartition(4), "key", ["y"], "r", hot=100)
    got = out.filter("y > 3").agg(F.count("*").alias("n"), F.count("__last.v").alias("held")).first()
    assert got.n == got.held == 19_980
    assert out.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    assert out.filter("y < 3 AND __last IS NOT NULL").isEmpty()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_components(edges):
    of = {x: x for e in edges for x in e}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {x: root(x) for x in of}


@pytest.mark.parametrize("chunk", [components.CHUNK, 50])
def test_components_of_random_graphs(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    r = random.Random(3)
    edges = [(f"n{r.randrange(300):03}", f"n{r.randrange(300):03}") for _ in range(220)] + [("hub", f"h{k}") for k in range(200)] + [("x", "x")]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = brute_components(edges)
    assert got == {k: v for k, v in want.items() if k != "x"}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", 4)
    r = random.Random(5)
    names = list(range(1001))
    r.shuffle(names)
    rounds = []
    got = components.components(spark.createDataFrame(list(zip(names, names[1:])), "a int, b int"), rounds)
    assert {x.component for x in got.collect()} == {0} and got.count() == 1001
    assert len(rounds) <= 15, rounds


def test_identity_over_three_batches(spark):
    """Ids of three batches that meet only in the last one: the rows of each are found again under what is known by then."""
    schema = "company_name string, isin string, symbol string, bse_code string"
    known = spark.createDataFrame([], "company_id string, company_name string, isin string")
    ids = []
    for batch in ([("Nila Pumps Ltd", None, "NILA", None)], [("Nila Pumps Limited", "INE5", None, None)], [("Nila Pumps and Motors", "INE5", None, None), ("Nila Pumps", None, None, "599")]):
        done = entity.resolve(spark.createDataFrame(batch, schema), known)
        ids.append({r.company_id for r in done.collect()})
        known = entity.merge(known, done.select("company_id", "company_name", "isin"))
    assert ids == [{"NSE:NILA"}] * 3


def brute_collapse(data):
    def same(a, b):
        if a[3] is not None and b[3] is not None:
            return abs(a[3] - b[3]) <= max(1.0, abs(a[3]) * 0.005) and abs((a[2] - b[2]) // DAY) <= 3
        return a[2] // DAY == b[2] // DAY and (a[5] or "") == (b[5] or "")

    out = []
    for c in {r[0] for r in data}:
        heads = []
        for x in sorted((r for r in data if r[0] == c), key=lambda r: (-r[2], r[1])):
            g = next((g for g in heads if same(g[0], x)), None)
            if g is None:
                heads.append([x])
            else:
                g.append(x)
        for g in heads:
            best = max(g, key=lambda r: (r[3] is not None, r[7] is not None, r[8] or 0.0, r[2], -r[1]))
            out.append((c, best[1], best[3], tuple(sorted({r[6] for r in g})), len(g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_collapse_of_random_filings(spark, seed):
    r = random.Random(seed)
    values = [None, 0.0, -3.0, 0.5, 1.4, 100.0, 100.9, 150.0, 1e9, 1.005e9, 1.01e9, 1.0049e9]
    data = [(r.randrange(3), k, r.choice([r.randrange(12 * DAY), r.randrange(12) * DAY, 3 * DAY - 1, 4 * DAY]), r.choice(values), None, r.choice([None, "a", "b"]), r.choice(["NSE", "BSE"]), r.choice([None, 6.0]), r.choice([None, 1.0, 2.0])) for k in range(300)]
    got = sorted(((x.company_id, x.order_id, x.order_value_inr, tuple(x.exchanges), x.duplicate_filings) for x in sequences.collapse(orders(spark, data)).collect()), key=repr)
    assert got == brute_collapse(data)


def test_a_company_that_files_every_hour_is_no_single_fold(spark):
    """Filings of different values an hour apart: what is folded together stays small however long it goes on."""
    rows = [(1, k, k * 3600, 1e6 * 1.013 ** (k * 37 % 997), None, "a", "NSE", None, None) for k in range(3000)]
    d = orders(spark, rows).withColumn("at", F.unix_seconds("filed_at"))
    of = components.components(sequences.possible_twins(d))
    most = of.groupBy("component").count().agg(F.max("count")).first()[0]
    assert (most or 0) < 50
    assert sequences.collapse(d.drop("at")).count() == len(brute_collapse([(c, o, s, v, *x) for c, o, s, v, *x in rows]))
