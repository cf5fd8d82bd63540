"""Operators on texts against brute force."""

import base64
import hashlib
import re
from collections import defaultdict

import public_tokenizers as P
import pyarrow as pa
import pytest

from tidemark.llm import bpe, core, decontaminate, graph, links, minhash, substring, tokencount

from . import cases

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS = P.path("byte_bpe_50k.tiktoken")


def hexed(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def tiktoken_():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_bpe_equals_tiktoken_and_round_trips(spark, tiktoken_):
    got = bpe.digests(cases.documents(spark, extra=True), RANKS, P.PATTERN)
    want = []
    for i, t in cases.rows():
        ids = tiktoken_.encode_ordinary(t or "")
        want.append((i, len(ids), hexed(" ".join(map(str, ids))), hexed(t or "")))
    assert collected(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.digests(cases.empty(spark), RANKS, P.PATTERN).count() == 0


def test_bpe_ids_of_long_text_in_blocks(spark, tiktoken_, monkeypatch):
    codec = bpe.Codec(bpe.serialise(bpe.read_ranks(RANKS)), bpe.read_ranks(RANKS), P.PATTERN)
    text = cases.prose(9, 3000) + " ünï 12345"
    whole = list(codec.blocks(text))
    monkeypatch.setattr(bpe, "LONG", 100)
    monkeypatch.setattr(bpe, "BLOCK", 37)
    parts = list(codec.blocks(text))
    assert len(whole) == 1 and len(parts) > 1 and " ".join(parts) == whole[0] == " ".join(map(str, tiktoken_.encode_ordinary(text)))
    assert codec.decode(whole[0]).decode() == text


def test_bpe_with_ids(spark, tiktoken_):
    r = bpe.encode(cases.documents(spark, [(1, "Hello world"), (2, None)]), RANKS, P.PATTERN, with_ids=True).collect()
    assert [x.token_ids for x in sorted(r, key=lambda x: x.doc_id)] == [tiktoken_.encode_ordinary("Hello world"), []]


def brute_components(data, shingle=5, percent=75):
    sets = defaultdict(list)
    sizes = []
    for i, t in data:
        w = SPLIT.findall((t or "").translate(LOWER))
        s = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
        sizes.append((i, len(s)))
        if i is not None and s:
            sets[i].append(s)
    parent = {i: i for i, _ in data if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted([(i, n, None if i is None else root(i), i is None or root(i) == i) for i, n in sizes], key=repr)


def test_minhash_groups(spark):
    d = cases.documents(spark, extra=True)
    assert collected(minhash.groups(d), "doc_id", "n_shingles", "component_id", "kept") == brute_components(cases.rows())
    assert minhash.groups(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("chunk", [graph.CHUNK, 9])
def test_components_in_chunks(spark, monkeypatch, chunk):
    """A chain, a hub and random pairs: the same components from one chunk and from rounds over many."""
    import random

    r = random.Random(2)
    order = list(range(90))
    r.shuffle(order)
    edges = [*zip(order, order[1:]), *((200, 201 + k) for k in range(40)), *((r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)), (7, 7), (500, 500)]
    monkeypatch.setattr(graph, "CHUNK", chunk)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), core.Scratch(spark, "t"), "g").collect()
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {g.node: g.component for g in got} == {x: root(x) for x in parent}


@pytest.mark.parametrize("hot", [core.HOT, 3])
def test_minhash_large_groups_in_tiles(spark, monkeypatch, hot):
    """A chain of near copies, each linked to its neighbours only, and templates of one frame, over many tiles; with keys that count as hot."""
    monkeypatch.setattr(core, "HOT", hot)
    monkeypatch.setattr(links, "TILE", 4)
    monkeypatch.setattr(minhash, "BUCKET", 3)
    monkeypatch.setattr(links, "RARE", 2)
    words = cases.prose(11, 200).split()
    data = []
    for k in range(30):
        words[(7 * k) % 200] = f"new{k}"
        data.append((100 + k, " ".join(words)))
    data += [(200 + k, cases.prose(50 + k, 60)) for k in range(5)]
    data += templates(24, 300) + templates(16, 400, rest=8) + templates(10, 500, rest=24)
    data += [(600, data[3][1] + " and more"), (601, templates(24, 300)[5][1] + " z"), (601, data[9][1]), (601, None)]
    got = collected(minhash.groups(cases.documents(spark, data)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components(data)


def templates(n, first, frame=60, rest=20):
    """Documents of one frame and so many words of their own: similar, but at the default sizes not linked."""
    head = cases.prose(5, frame)
    return [(first + k, head + " " + " ".join(f"own{first + k}x{j}" for j in range(rest))) for k in range(n)]


def test_minhash_rows_grow_with_templates_not_with_their_pairs(spark, monkeypatch):
    """Unlinked documents of one frame that all become candidates: the rows written in between must grow in proportion."""
    monkeypatch.setattr(links, "TILE", 20)
    monkeypatch.setattr(minhash, "BUCKET", 10)
    rows, write = [0], core.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        rows[0] += out.count()
        return out

    monkeypatch.setattr(core.Scratch, "write", counted)
    seen = {}
    for n in (150, 600):
        rows[0] = 0
        data = templates(n, 1000) + [(7, templates(n, 1000)[n // 2][1] + " tail")]
        got = minhash.groups(cases.documents(spark, data))
        linked = got.filter("component_id <> doc_id").collect()
        assert [(r.doc_id, r.component_id) for r in linked] == [(1000 + n // 2, 7)]
        seen[n] = rows[0]
    assert seen[600] < 4.6 * seen[150], seen


def test_minhash_estimate_is_corrected():
    values, more, bounds = links.sets(pa.array([cases.prose(1, 400), cases.prose(1, 400)[:-1] + "z", cases.prose(77, 400)], pa.large_string()), 5, both=True)
    _, _, sig = minhash.sketch(values, more, bounds)
    assert minhash.estimate(sig[:1], sig[1:2])[0] > 0.9
    assert abs(minhash.estimate(sig[:1], sig[2:3])[0]) < 0.2


def brute_substring(data):
    first = {}
    docs = [(i, SPLIT.findall(t or "")) for i, t in data]
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - 12):
                p = tuple(w[k : k + 13])
                first[p] = min(first.get(p, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), hexed(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 2000}])
def test_substring(spark, sizes):
    d = cases.documents(spark, extra=True)
    got = substring.deduplicate(d, **sizes)
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(cases.rows())
    assert substring.report(cases.empty(spark)).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


def look_alikes():
    """Texts that differ in one long word only, which a polynomial hash modulo a power of two cannot tell apart."""
    lead, out = " ".join(f"w{k}" for k in range(12)), []
    for k, n in enumerate((32, 64, 512, 1024, 2048, 4096, 8192)):
        out += [(10 * k, f"{lead} {thue_morse(n)}"), (10 * k + 1, f"{lead} {thue_morse(n, 'b', 'a')}"), (10 * k + 2, f"{lead} {thue_morse(n)}")]
    tm = thue_morse(256).replace("a", "left ").replace("b", "right ")
    return [*out, (100, tm), (101, tm.replace("left", "x").replace("right", "left").replace("x", "right")), (102, "a\0"), (103, "a"), (104, thue_morse(64)), (105, thue_morse(64, "b", "a"))]


def test_words_that_look_alike_to_a_polynomial(spark):
    data = look_alikes()
    d = cases.documents(spark, data)
    assert collected(substring.report(d), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(data)
    assert collected(minhash.groups(d), "doc_id", "n_shingles", "component_id", "kept") == brute_components(data)


def test_word_hashes():
    """Both streams give every word of many lengths its own value, wherever it stands."""
    import numpy as np

    from tidemark.llm import core, words

    said = sorted({t[:n] for t in (thue_morse(4096), thue_morse(4096, "b", "a"), "x" * 300, "\u00e9" * 90) for n in range(1, len(t), 37)} | {f"w{k}" for k in range(5000)})
    data, offsets = core.bytes_of(pa.array([" ".join(said), " ".join(reversed(said)), " ".join(said).upper()], pa.large_string()))
    starts, ends, bounds = words.spans(data, offsets)
    for stream in (0, 1):
        h = words.hashes(data, starts, ends, stream=stream)
        one, two = (h[i:j] for i, j in zip(bounds[:2], bounds[1:3]))
        assert len(np.unique(one)) == len(said) and (one == two[::-1]).all()
        folded = words.hashes(data, starts, ends, fold=True, stream=stream)
        assert (folded[bounds[0] : bounds[1]] == one).all()
        plain = np.array([w.isascii() for w in said])
        assert (folded[bounds[2] : bounds[3]] == one)[plain].all()


def test_difference_cover_holds_every_shift():
    on = [k for k in range(substring.PERIOD) if substring.COVER[k]]
    assert {(a - b) % substring.PERIOD for a in on for b in on} == set(range(substring.PERIOD))
    assert substring.ANCHOR + substring.PERIOD - 1 == substring.WIDTH


ITEMS = [(3, cases.prose(2, 300)[:200]), (30, "one two three"), (4, cases.prose(3, 40)), (5, None), (6, "..."), (None, cases.prose(5, 30)), (4, cases.prose(3, 40)), (7, "tokyo 東京")]


def brute_hits(data, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        if not w:
            continue
        for p in [tuple(w)] if len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]:
            windows[p].add(None if i is None else str(i))
    out = []
    for i, t in data:
        w, hit, found = split(t), set(), set()
        for n in {len(p) for p in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hexed(",".join(sorted(x for x in found if x is not None))), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [200_000, 25])
def test_decontamination(spark, most):
    data = [*cases.rows(), (40, "x one, TWO; three y"), (41, "東京 tokyo 東京 tokyo 東京")]
    d, b = cases.documents(spark, data, extra=True), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.search(d.select("doc_id", "text", "score", "contaminated"), b, most=most)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert collected(got, *cols) == brute_hits(data, ITEMS)
    assert decontaminate.report(cases.empty(spark), b).count() == 0
    assert decontaminate.report(d, b.limit(0)).filter("contaminated or n_items > 0").count() == 0


def test_token_counts(spark, tiktoken_, monkeypatch):
    d = cases.documents(spark, extra=True)
    want = sorted([(i, len(tiktoken_.encode_ordinary(t or ""))) for i, t in cases.rows()], key=repr)
    assert collected(tokencount.report(d, RANKS, P.PATTERN, 50256), "doc_id", "n_tokens") == want
    monkeypatch.setattr(tokencount, "RUN", 3)
    files = tokencount.pack(d, RANKS, P.PATTERN, eod=50256, block=64)
    from tidemark.llm import core

    scanned = core.Scratch(spark, "t").write(tokencount.scan(files, eod=50256), "s")
    assert collected(tokencount.stitch(scanned), "doc_id", "n_tokens") == want
    assert tokencount.report(cases.empty(spark), RANKS, P.PATTERN, 50256).count() == 0


def test_token_files(spark, tmp_path):
    import numpy as np

    (tmp_path / "a.bin").write_bytes(np.array([5, 6, 9, 9, 7, 8, 8], "<u4").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = tokencount.stitch(tokencount.scan(tokencount.read(spark, str(tmp_path), dtype="<u4", block=2), eod=9, dtype="<u4"))
    assert collected(got, "doc_index", "start", "n_tokens", "ended") == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]
