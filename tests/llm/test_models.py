"""Classifiers on held-out rows, the tree search against brute force, WARC records by a round trip."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import ann, langid, quality, toxicity, warc

from . import cases

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(got[i].predicted, q) for i, q in truth.items() if got[i].held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_quality_attention_gradient():
    """The analytic gradient lowers the loss on a bag problem that single passages decide."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality.FEATURES))
    first = np.arange(0, 301, 3)
    y = (np.arange(100) % 2).astype(float)
    x[first[:-1][y == 1] + 1, 0] += 6
    m = quality.train(x, first, y, np.ones(100), 0.5)
    assert np.mean((m.scores(x, first) >= 0.5) == y) > 0.97


def test_quality_cases(spark):
    d = cases.documents(spark, extra=True)
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, None), (None, 1), (7, 0), (99, 1), (10, 1), (11, 0)], "doc_id long, quality int")
    r = quality.report(d, labels).collect()
    assert len(r) == len(cases.rows()) and all(0 <= x.score <= 1 for x in r)
    none = quality.report(d, labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5}
    assert quality.report(cases.empty(spark), labels).count() == 0


def test_language_on_held_out(spark, tables):
    docs, _ = tables
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.collect() if got[r.doc_id].held_out]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.98


def test_language_cases(spark):
    d = cases.documents(spark, extra=True)
    r = {x.doc_id: x for x in langid.report(d).collect()}
    assert r[4].lang_pred == r[5].lang_pred == r[6].lang_pred == "und" and r[4].score == 0
    assert r[7].lang_pred == "en" and r[7].score == 1
    two = cases.documents(spark, [(k, ("der und die " if k % 2 else "the and of ") * 5) for k in range(60)] + [(61, "123 !"), (62, None)])
    from pyspark.sql import functions as F

    two = two.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "de").otherwise("en"))
    r = {x.doc_id: x.lang_pred for x in langid.report(two).collect()}
    assert all(r[k] == ("de" if k % 2 else "en") for k in range(60)) and r[61] == r[62] == "und"
    assert langid.report(cases.empty(spark)).count() == 0


def toxic_documents(n=400):
    data = []
    for k in range(n):
        w = cases.prose(k, 80).split()
        if k % 4 == 0:
            for j in range(1 + k % 3):
                w[(13 * k + 29 * j) % 80] = ("idiot", "scum", "vermin")[(k + j) % 3]
        data.append((k, " ".join(w)))
    return data


def test_toxicity(spark):
    data = toxic_documents()
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in data], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(cases.documents(spark, data, extra=True), labels).collect()}
    held = [(r.toxic, k % 4 == 0) for k, r in got.items() if r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    many, few = ([r.severity for k, r in got.items() if k % 12 == j] for j in (8, 0))
    assert np.mean(many) > np.mean(few) > 0.5


def test_toxicity_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    col = rng.integers(0, 6, 600)
    row = np.repeat(np.arange(200), 3)
    grade = np.clip(np.bincount(row, col == 0, 200) + np.bincount(row, col == 1, 200), 0, 2).astype(int)
    t, w = toxicity.train(row, col, grade, 6, np.ones(200))
    assert t[0] <= t[1] and min(w[0], w[1]) > max(w[2:])


def test_toxicity_on_held_out_labels(spark, tables):
    """The two-valued labels of the tables: nearly no clean document is marked; some marked ones hold no word that tells."""
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    held = [(got[r.doc_id].toxic, r.toxic == 1) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    marked, clean = ([a for a, b in held if b is side] for side in (True, False))
    assert len(marked) >= 5 and np.mean(marked) >= 0.6 and np.mean(clean) <= 0.02


def test_toxicity_of_given_grades(spark, monkeypatch):
    """Four grades, told by words of their own: held-out severities rise with the grade; grades past the most are left out."""
    words = ["mild", "rough", "vile"]
    data = [(k, cases.prose(k, 40) + " " + " ".join(words[: k % 4] * 2)) for k in range(600)]
    docs, labels = cases.documents(spark, data), spark.createDataFrame([(k, k % 4) for k, _ in data], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    mean = [np.mean([r.severity for k, r in got.items() if r.held_out and k % 4 == g]) for g in range(4)]
    assert all(b - a > 0.5 for a, b in zip(mean, mean[1:])), mean
    monkeypatch.setattr(toxicity, "MOST_VALUES", 2)
    assert toxicity.report(docs, labels).count() == 600


def test_languages_past_the_most_are_left_out(spark, monkeypatch):
    said = {"aa": "kala mina tovo ", "bb": "streng zwolf brucke ", "cc": "ploc ploc quix "}
    rows = [(k, said[g] * (3 + k % 5), g) for k, g in enumerate((["aa"] * 60 + ["bb"] * 60 + ["cc"] * 3))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    got = langid.report(d).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"aa", "bb"}
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got if rows[r.doc_id][2] != "cc"]) > 0.95


def test_toxicity_cases(spark):
    d = cases.documents(spark)
    labels = spark.createDataFrame([(0, 1), (3, 0), (10, 0), (7, None), (None, 1), (12, 1), (12, 0)], "doc_id long, toxic int")
    r = toxicity.report(d, labels).collect()
    assert len(r) == len(cases.rows()) and all(math.isfinite(x.severity) and 0 <= x.p_toxic <= 1 for x in r)
    assert {x.severity for x in toxicity.report(d, labels.limit(0)).collect()} == {0.0}
    assert toxicity.report(cases.empty(spark), labels).count() == 0


def brute_neighbours(rows, every=20, k=20):
    """By row: the ids and scores of the nearest other rows; a shorter vector counts as filled up with zeros."""
    good = [(i, v) for i, v in rows if not (i is None or v is None or any(c is None or not math.isfinite(c) for c in v) or not any(v))]
    width = max(len(v) for _, v in good)
    ids, x = np.array([i for i, _ in good]), np.array([v + [0.0] * (width - len(v)) for _, v in good])
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        s = (x * x[n]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
        out.setdefault(int(ids[n]), []).append([(int(ids[j]), float(s[j])) for j in order])
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 8)).round(3).tolist()


def test_neighbours_small_table_is_exact(spark):
    rows = list(enumerate(vectors(300)))
    rows += [(i, rows[40][1]) for i in range(300, 360)]  # one vector of many rows
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0, None] + [0.0] * 6), (480, [1.0] * 9), (None, vectors(1)[0]), (40, rows[40][1]), (500, [float("inf")] * 8)]
    rows += [(60, rows[7][1]), (60, rows[60][1]), (61, [2.0, 1.0]), (80, [3.0]), (81, [0.5] * 11)]  # ids of several rows, other lengths
    random.Random(3).shuffle(rows)
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.search(e, recall=1.0).collect(), key=lambda r: (r["rank"], r.vec_id)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_neighbours(rows)
    assert got.keys() == want.keys() and {len(want[q]) for q in (40, 60, 80)} == {2, 3}
    for q in want:
        flat = [x for one in want[q] for x in one]
        assert len(got[q]) == len(flat)
        near = lambda xs: sorted((i, round(s, 9)) for i, s in xs)
        assert len(set(near(got[q])) & set(near(flat))) >= 0.9 * len(set(near(flat)))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q][0]}) / 20 for q in want if len(want[q]) == 1]) > 0.97


def test_visits_fall_with_the_table_where_vectors_cluster():
    """Clusters of 25: the share of vectors in the leaves that calibration asks for falls as there are more of them; recall holds."""
    rng, share = np.random.default_rng(1), []
    for n in (1_000, 4_000, 16_000):
        centres = rng.normal(size=(n // 25, 16))
        x = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 25, 0) + rng.normal(size=(n, 16)) * 0.05
        tree = ann.build(x)
        visits, leaf = ann.calibrate(tree, x, 20), tree.place(x)
        held, seen, hits = np.bincount(leaf, minlength=tree.leaves), [], []
        for i in range(0, n, n // 50):
            first = [v for v, _ in zip(tree.order(x[i]), range(visits))]
            s = x @ x[i]
            best = np.argsort(-s)[1:21]
            seen.append(held[first].sum() / n)
            hits.append(np.isin(leaf[best], first).mean())
        share.append(np.mean(seen))
        assert np.mean(hits) >= 0.9
    assert share[0] > 2 * share[1] > 4 * share[2] and share[2] < 0.01, share


def test_neighbours_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in e.collect()]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    got = {}
    for r in ann.search(e).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for j in np.flatnonzero(ids % 20 == 0):
        s = (x * x[j]).sum(1)
        s[j] = -np.inf
        recall.append(len(got[ids[j]] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbours_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(few).collect()]
    assert sorted(got) == [(0, 1, 1, 1.5), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert ann.search(few.limit(0)).count() == 0


PAGES = [
    (1, "http://a.example/x", '<html lang="en"><head><title>A &amp; B</title><script>var x="<p>";</script></head><body><p>One<br>two &lt;3&gt;</p><a href="/next">next</a></body></html>'),
    (2, None, None), (3, "http://b.example/", ""), (None, "http://a.example/x", "<p>ünï</p>"), (4, "http://c.example/", "<b>" * 50_000), (4, "http://c.example/", "<b>" * 50_000),
]


def test_warc_records(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("block", F.lit("mine")).withColumn("record_id", F.lit("mine"))
    out = [r.asDict(recursive=True) for r in warc.report(pages).collect()]
    assert len(out) == 2 * len(PAGES)
    one = {r["warc_type"]: r for r in out if r["page_id"] == 1}
    assert bytes(one["conversion"]["block"]).decode() == "A & B\nOne\ntwo <3>\nnext"
    meta = bytes(one["metadata"]["block"]).decode()
    assert "title: A & B\r\n" in meta and "language: en\r\n" in meta and "outlink: /next L a/@href\r\n" in meta and "source-header-content-type: text/html; charset=utf-8\r\n" in meta
    assert one["metadata"]["refers_to"] == one["conversion"]["refers_to"] != one["conversion"]["record_id"]
    assert one["conversion"]["payload_digest"] == warc.digest(PAGES[0][2].encode()) and one["conversion"]["block_digest"] == warc.digest(bytes(one["conversion"]["block"]))
    (tmp_path / "all.warc").write_bytes(b"".join(warc.serialise(r) for r in out))
    back = warc.read(spark, str(tmp_path / "all.warc")).collect()
    key = lambda r: (r["record_id"], r["warc_type"], r["refers_to"], r["target_uri"], r["block_digest"], r["payload_digest"], [tuple(h.values() if isinstance(h, dict) else h) for h in r["source_headers"]], bytes(r["block"]))
    assert sorted(map(key, back), key=repr) == sorted(map(key, out), key=repr)
    assert warc.report(pages.limit(0)).count() == 0
    assert warc.with_bytes(warc.report(pages)).filter("record is null").count() == 0


def response(body, *headers):
    return "\r\n".join(["HTTP/1.1 200 OK", *headers]).encode("latin-1") + b"\r\n\r\n" + body


def test_warc_bodies_are_decoded(spark):
    import gzip
    import zlib

    page = "<p>caf\u00e9</p>"
    chunked = lambda b: b"".join(f"{len(c):x};x=1\r\n".encode() + c + b"\r\n" for c in (b[:5], b[5:])) + b"0\r\n\r\n"
    blocks = {
        "latin": response(page.encode("latin-1"), "Content-Type: text/html; charset=iso-8859-1"), "utf": response(page.encode()), "meta": response(b'<meta charset="windows-1252">' + page.encode("cp1252")),
        "gzip": response(gzip.compress(page.encode()), "Content-Encoding: gzip"), "deflate": response(zlib.compress(page.encode())[2:-4], "Content-Encoding: deflate"), "both": response(chunked(gzip.compress(page.encode())), "Transfer-Encoding: chunked", "Content-Encoding: gzip"),
        "chunks": response(chunked(page.encode()), "Transfer-Encoding: chunked"), "odd": response(page.encode(), "Content-Type: text/html; charset=no-such", "Content-Encoding: gzip, br"),
    }
    rows = [(k, f"http://x.example/{k}", "2024-01-01T00:00:00Z", bytearray(b), 7) for k, b in blocks.items()]
    d = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, block binary, Content_Length int")
    out = warc.derive(d, keep=["record_id", "Content_Length"]).collect()
    got = {r.source_record_id: bytes(r.block).decode() for r in out if r.warc_type == "conversion"}
    assert got == dict.fromkeys(blocks, "caf\u00e9") and {r.source_Content_Length for r in out} == {7}
    digests = {r.source_record_id: r.payload_digest for r in out}
    assert digests["chunks"] == warc.digest(page.encode()) == digests["utf"] and digests["both"] == digests["gzip"]


def test_warc_broken_chunks_end(spark):
    """Chunk sizes that are no sizes, or do not fit: the body is read as it is, and soon."""
    bad = [b"-6\r\nabc", b"+3\r\nabc\r\n0\r\n", b"1_0\r\nabcdefghijklmnop\r\n0\r\n", b"0x3\r\nabc\r\n0\r\n", b"\r\nabc", b"ffffffffffffffff\r\nabc", b"9\r\nabc\r\n0\r\n", b"2\r\nabc\r\n0\r\n", b" 3\r\nabc\r\n", b"zz\r\nabc", b"3\r\nabc\r\n-1\r\n", b"11111111111111111\r\nabc"]
    for body in bad:
        assert warc._unchunked(body) == body
    assert warc._unchunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc" == warc._unchunked(b"3 \r\nabc\r\n") == warc._unchunked(b"3\r\nabc")
    rows = [(str(k), "http://x.example/", "2024-01-01T00:00:00Z", bytearray(response(b, "Transfer-Encoding: chunked"))) for k, b in enumerate(bad)]
    out = warc.derive(spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, block binary"), keep=["record_id"]).filter("warc_type = 'conversion'").collect()
    assert {r.source_record_id: bytes(r.block).decode() for r in out} == {str(k): warc.plain(b.decode()) for k, b in enumerate(bad)}


def test_warc_bodies_that_would_grow_too_large(monkeypatch):
    import gzip
    import zlib

    import zstandard

    monkeypatch.setattr(warc, "MOST_DECODED", 1000)
    for pack, encoding in ((gzip.compress, "gzip"), (zlib.compress, "deflate"), (zstandard.compress, "zstd")):
        assert warc._unpacked(pack(b"a" * 900), encoding) == b"a" * 900
        assert warc._unpacked(pack(b"a" * 5000), encoding) == pack(b"a" * 5000)


def test_warc_records_by_another_reader(spark):
    """Records as written, read by the standard library's header parser, HTML parser and digests."""
    import email.parser
    import hashlib
    from base64 import b32encode
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "template", "noscript")
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "template", "noscript")
            self.out.append(" ")

        def handle_data(self, data):
            self.out.append("" if self.off else data)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r for r in pages.collect()}
    sha = lambda b: "sha1:" + b32encode(hashlib.sha1(b).digest()).decode()
    seen = 0
    for r in warc.with_bytes(warc.report(pages)).collect():
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        version, head = head.split(b"\r\n", 1)
        said = email.parser.BytesHeaderParser().parsebytes(head)
        block = block[: int(said["Content-Length"])]
        source = html[r.page_id]
        assert version == b"WARC/1.1" and said["WARC-Target-URI"] == source.url and said["WARC-Block-Digest"] == sha(block) and said["WARC-Payload-Digest"] == sha((source.html or "").encode())
        assert [h.split(":")[0] for h in said.get_all("WARC-Source-Header")] == ["Content-Type", "Content-Length"] and said["WARC-Refers-To"] == r.refers_to
        if said["WARC-Type"] == "conversion":
            words = Words()
            words.feed(source.html or "")
            assert "".join("".join(words.out).split()) == "".join(block.decode().split())
            seen += 1
        else:
            lines = block.decode().split("\r\n")
            assert f"source-payload-digest: {sha((source.html or '').encode())}" in lines and lines[0] == "source-status: HTTP/1.1 200 OK"
    assert seen == len(html)


def test_warc_files_with_faults(spark, tmp_path):
    (tmp_path / "odd.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: resource\r\nX: \xff\r\n\r\nno length\r\n\r\nWARC/1.1\r\nWARC-Type: info\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\ncut")
    got = [(r.warc_type, bytes(r.block)) for r in warc.read(spark, str(tmp_path / "odd.warc")).collect()]
    assert got == [("resource", b"no length"), ("info", b"abc")]
    row = {"warc_type": "info", "record_id": "<a>", "target_uri": "http://a/\r\nX-Bad: 1", "block": b""}
    assert b"\r\nX-Bad" not in warc.serialise(row)
