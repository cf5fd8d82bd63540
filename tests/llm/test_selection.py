"""Importance resampling, the parity-sketch join and the audit of filters against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import core, jaccard, links, resample

from . import cases
from .test_texts import ITEMS, LOWER, brute_components, collected, look_alikes, templates

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute_draw(data, items, percent=5, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in data for f in runs(t)[1])
    t = Counter(bucket(f) for _, x in items for f in runs(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out, may = [], []
    for i, x in data:
        n, found = runs(x)
        weight = sum(gain[bucket(f)] for f in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                may.append((-score, i, -weight, -len(found)))
        out.append((i, len(found), weight, score))
    rank = {}
    for k, key in enumerate(sorted(may)[: percent * len(may) // 100]):
        rank.setdefault(key, []).append(k + 1)
    return sorted([(*r, rank[key].pop(0) if r[3] is not None and (key := (-r[3], r[0], -r[2], -r[1])) in rank and rank[key] else None) for r in out], key=repr)


COLS = ("doc_id", "n_features", "weight", "score", "rank")


def test_crc_by_distance():
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 9000).astype(np.uint8)
    sizes = np.array([1, 2, 3, 4, 5, 63, 64, 65, 127, 128, 129, 191, 1000, 4096, 1])
    starts = np.cumsum(sizes + r.integers(1, 90, len(sizes))) - sizes
    assert resample.crcs(data, starts, starts + sizes).tolist() == [zlib.crc32(data[i : i + n].tobytes()) for i, n in zip(starts, sizes)]


def test_features_are_all_runs():
    texts = [t for _, t in cases.rows()] + ["a" * 61 + " " + "b" * 400 + " c", "A-b_C 9é"]
    bucket, owner, n = resample.features(core.text_of(pa.array(texts)), 977)
    for k, t in enumerate(texts):
        many, found = runs(t)
        assert n[k] == many and sorted(bucket[owner == k].tolist()) == sorted(zlib.crc32(f.encode()) % 977 for f in found)


def test_resampling(spark):
    data = [*cases.rows(), *[(100 + k, cases.prose(100 + k, 15 + k)) for k in range(60)], (100, cases.prose(7, 50))]
    target = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = resample.report(cases.documents(spark, data, extra=True), target)
    assert collected(got, *COLS) == brute_draw(data, ITEMS)
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert collected(resample.report(cases.documents(spark, data), target.limit(0)), *COLS) == brute_draw(data, [])
    assert resample.report(cases.empty(spark), target).count() == 0


def test_ranks_over_many_ranges(spark):
    rows = [(k, (k * 7919) % 13) for k in range(500)]
    d = spark.createDataFrame(rows, "id long, score long").repartition(7)
    from pyspark.sql import functions as F

    got = resample.rank(d, [F.desc("score"), F.asc("id")], F.floor(F.col("n") * 90 / 100), core.Scratch(spark, "t"))
    want = {i: k + 1 for k, (_, i) in enumerate(sorted((-s, i) for i, s in rows)) if k < 450}
    assert {r.id: r["rank"] for r in got.collect()} == {i: want.get(i) for i, _ in rows}


def test_draw_keeps_columns(spark):
    d = cases.documents(spark, [(k, cases.prose(k, 40)) for k in range(40)]).withColumn("weight", F_lit("mine"))
    out = resample.draw(d, cases.documents(spark, [(1, cases.prose(1, 40))]), percent=50)
    assert {"lang", "source", "n_chars", "weight", "rank"} <= set(out.columns) and out.filter("rank is not null").count() == 20


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def brute_audit(data, labels):
    """Filter by filter, order by order, over lists of documents."""
    from itertools import permutations

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    least = {}
    for i, t, _ in data:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = {
        "A": lambda i, t: len(words(t)) < 200, "B": lambda i, t: 100 * len(set(words(t))) < 50 * len(words(t)), "C": lambda i, t: 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
        "D": lambda i, t: bool(set(t) & set("#$%&*|")), "E": lambda i, t: i is not None and i > least[t],
    }
    docs = [(lang or "", {x for x, f in fails.items() if f(i, t or "")}, labels.get(i, (0, 0))) for i, t, lang in data]
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in docs}:
        for order in permutations("ABCDE"):
            here = [(f, told) for p, f, told in docs if p == part]
            gone = []
            for k, x in enumerate(order):
                lost = [d for d in here if x in d[0]]
                here = [d for d in here if x not in d[0]]
                out[part, "".join(order), k + 1] = [len(here), len(lost), sum(x in d[0] for d in gone), sum(f == {x} for p, f, _ in docs if p == part), sum(d[1][0] for d in lost), sum(d[1][1] for d in lost)]
                gone += lost
                shapley[part, x] += len(lost)
    return sorted((p, o, k, *v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items())


AUDITED = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("batches", [1, 9])
def test_audit_of_filters(spark, tmp_path, monkeypatch, batches):
    """Copies of a text come in every order of ids, over many files and batches: what was counted is taken back."""
    from tidemark.llm import audit

    monkeypatch.setattr(audit, "PER_BUCKET", 9)
    long = cases.prose(1, 300)
    texts = [*cases.rows(), (30, long), (20, long), (40, long), (25, long), (19, long), (19, long), (18, long + " #"), (50, long + " #"), (17, long + " #"), (None, long), (60, "A b C d"), (61, "a a a a b " * 50), (16, ""), (3, None)]
    data = [(i, t, (None, "", "en", "de")[k % 4]) for k, (i, t) in enumerate(texts)]
    labels = {3: (1, 0), 20: (1, 0), 19: (0, 1), 61: (1, 1), 25: (1, 0), 13: (1, 1)}
    for k, r in enumerate(data):
        cases.documents(spark, [r[:2]]).selectExpr("doc_id", "text", f"cast({'null' if r[2] is None else repr(r[2])} AS string) AS lang", "'mine' AS mask", "'x' AS part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    told = spark.createDataFrame([(i, g, t) for i, (g, t) in labels.items()] + [(13, 0, None), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    counted = audit.counters(spark, f"{tmp_path}/documents.parquet", told, batches=batches)
    assert collected(audit.orders(counted), *AUDITED) == brute_audit(data, labels)


def test_audit_of_nothing(spark, tmp_path):
    from tidemark.llm import audit

    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    told = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.report(spark, f"{tmp_path}/documents.parquet", told).count() == 0


def test_audit_keeps_the_settings_of_the_session(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with core.settings(spark, {"spark.sql.streaming.stateStore.providerClass": "x", "spark.tidemark.unset": "1"}):
        assert spark.conf.get("spark.tidemark.unset") == "1"
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before and spark.conf.get("spark.tidemark.unset", None) is None


def brute_join(data):
    return [r[:3] for r in brute_components(data, 3, 90)]


def near_copies():
    """Documents of many sizes, each with copies on both sides of the bound, one word of difference at a time."""
    out = []
    for k, n in enumerate((3, 5, 9, 10, 11, 12, 13, 20, 30, 45, 60, 100, 200, 400)):
        w = cases.prose(900 + k, n).split()
        for j in range(6):
            changed = list(w)
            for x in range(j * max(1, n // 60)):
                changed[(x * 37 + 5) % n] = f"other{j}"
            out.append((1000 * k + j, " ".join(changed)))
        out += [(1000 * k + 50 + j, " ".join(w[: n - j])) for j in (1, 2, n // 12)]
    return out


def test_linked_sets_share_a_part():
    """No link is missed: sets at the very bound, grown, shrunk and changed, of all sizes up to a few thousand."""
    r = np.random.default_rng(5)
    tried = 0
    for trial in range(1500):
        n = int(r.integers(9, 60) if trial % 2 else r.integers(60, 3000))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        most = 2 * n * 10 // 190
        gone = int(r.integers(0, most + 1))
        b = np.unique(np.concatenate([a[gone:], r.integers(0, 2**63, int(r.integers(0, most - gone + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
            key, cuts = jaccard.parts(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert len(np.intersect1d(key[: cuts[1]], key[cuts[1] :])), (len(a), len(b), both)
            tried += 1
    assert tried > 1000


def test_unlike_sets_share_no_part():
    r = np.random.default_rng(6)
    values = [np.unique(r.integers(0, 2**63, int(n)).astype(np.uint64)) for n in r.integers(40, 2000, 300)]
    key, _ = jaccard.parts(np.concatenate(values), np.append(0, np.cumsum([len(v) for v in values])))
    assert len(key) - len(np.unique(key)) < len(values) / 10


def test_bands_cover_all_sizes_and_hold_the_distance():
    lows, many, spares = jaccard.bands(5000)
    size = np.arange(1, 4500)
    who, band = jaccard.members(size, lows)
    homes = {}
    for i, b in zip(size[who].tolist(), band.tolist()):
        homes.setdefault(i, set()).add(b)
    for y in range(10, 4500):
        for x in {y, -(-90 * y // 100)}:
            if 2 * min(x, y) * 10 // 190 >= 1 or (x + y) * 10 // 190 >= 1:
                shared = homes[x] & homes[y]
                assert any(many[b] - spares[b] > (x + y) * 10 // 190 for b in shared), (x, y)


@pytest.mark.parametrize("fold", [1 << 20, 7])
def test_parity_join(spark, monkeypatch, fold):
    monkeypatch.setattr(jaccard, "FOLD", fold)
    monkeypatch.setattr(links, "TILE", 4)
    monkeypatch.setattr(links, "RARE", 2)
    data = [*cases.rows(), *near_copies(), *templates(12, 50_000, frame=200, rest=6), (70_000, templates(12, 50_000, frame=200, rest=6)[4][1] + " z"), (70_000, cases.prose(3, 40)), (70_000, None), *[(80_000 + k, t) for k, (_, t) in enumerate(look_alikes())]]
    got = jaccard.groups(cases.documents(spark, data, extra=True))
    assert collected(got, "doc_id", "n_shingles", "component_id") == sorted(brute_join(data), key=repr)


def test_parity_join_of_nothing(spark):
    assert jaccard.groups(cases.empty(spark)).count() == 0
    assert collected(jaccard.groups(cases.documents(spark, [(1, None), (2, ""), (None, "a b c d")])), "doc_id", "n_shingles", "component_id") == sorted([(1, 0, 1), (2, 0, 2), (None, 2, None)], key=repr)
