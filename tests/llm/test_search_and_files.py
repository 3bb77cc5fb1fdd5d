"""Vector search, URL filter, WARC archives and licence scan against plain versions."""

import base64
import gzip
import hashlib
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joblore.llm import license_scan, url_filter, vector_search, warc
from joblore.llm.license_texts import TEMPLATES
from joblore.llm.scratch import new_path
from tests.llm import brute


def nearest(rows, query_ids, k):
    out = []
    for q in query_ids:
        scores = [(-sum(float(a) * float(b) for a, b in zip(rows[q], v, strict=True)), i) for i, v in rows.items() if i != q and len(v) == len(rows[q])]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_vectors(spark):
    r = np.random.default_rng(1)
    rows = {i: r.standard_normal(24).tolist() for i in range(300)}
    rows |= {i: rows[3] for i in range(300, 340)} | {i: [x * 1e3 for x in rows[5]] for i in range(340, 343)} | {400: [1.0, 2.0], 401: [2.0, 1.0], 420: [3.0, 3.0]}
    bad = [(500, None), (520, []), (540, [0.0] * 24), (560, [None] + [1.0] * 23), (580, [float("nan")] * 24), (600, [float("inf")] * 24), (None, rows[1]), (20, rows[20])]
    table = spark.createDataFrame([(i, v, 1, 0.5) for i, v in [*rows.items(), *bad]], "vec_id long, embedding array<double>, block int, score double").repartition(5)
    index = vector_search.build_index(table)
    assert index.count() == len(rows)
    got = vector_search.search(index, index.filter("vec_id % 20 = 0"), 20, query_rows=7).collect()
    exact = nearest(rows, [i for i in rows if i % 20 == 0], 20)
    found = {(g.query_id, g.vec_id) for g in got}
    assert len(found & {(q, i) for q, _, i, _ in exact}) >= 0.99 * len(exact)
    assert {(g.query_id, g["rank"]) for g in got} == {(q, rank) for q, rank, _, _ in exact}
    assert all(abs(g.score - sum(a * b for a, b in zip(rows[g.query_id], rows[g.vec_id], strict=True))) < 1e-6 * max(1, abs(g.score)) for g in got)
    ties = [g.vec_id for g in sorted(got, key=lambda g: g["rank"]) if g.query_id == 0 and g.vec_id >= 300 and g.vec_id < 340]
    assert ties == sorted(ties)


def test_vectors_empty(spark):
    index = vector_search.build_index(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert vector_search.search(index, index).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the tables are not here")
def test_recall(spark):
    """Of the 20 nearest by brute force nearly all are found, and most vectors need no exact product."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vector_search.build_index(table)
    got = vector_search.search(index, index.filter("vec_id % 20 = 0")).collect()
    rows = index.select("vec_id", "vector").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.vector for r in rows])
    expected = set()
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        expected |= {(ids[i], j) for j in ids[np.lexsort((ids, -score))[:20]]}
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found) == len(got) == len(expected) and len(found & expected) >= 0.99 * len(expected)


def test_vector_bounds():
    """The error bound holds for all but few vectors."""
    r = np.random.default_rng(2)
    x, q = r.standard_normal((2000, 32)), r.standard_normal(32)
    x, q = x / np.linalg.norm(x, axis=1)[:, None], q / np.linalg.norm(q)
    turn = vector_search.rotation(32, 128, 7)
    assert np.allclose(turn @ turn.T, np.eye(32))
    turned = x @ turn
    fit = np.abs(turned).sum(axis=1) / 128**0.5
    estimate = np.sign(turned) @ (q @ turn) / 128**0.5 / fit
    error = np.abs(estimate - x @ q)
    assert (error > 4 * np.sqrt((1 - fit**2) / fit**2 / 127)).mean() < 0.001


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("odd.org", "", "block")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(brute.LOWER), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls(spark):
    r = random.Random(3)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "xexample.com", "b.net", "net", "c.b.net", "odd.org", "q.odd.org", "com", "", "..com", "é.net", "example.com."]
    urls = [f"http{r.choice(['', 's'])}://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en", "/en/x?y#z", "?/en/", "#a", "/es/1", "/fr/://x", "/\n/en/")] + [None, "", "no scheme", "://x.com/", "a://b://c.net/es/"]
    urls += [f"https://h{i}.example{i}.net/p{i}/" for i in range(2000)]
    table = spark.createDataFrame([(i, u, "old", 7) for i, u in enumerate(urls)], "page_id long, url string, rule string, __key int").repartition(4)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(table, rules).collect()
    assert {(g.page_id, g.host, g.path, g.rule, g.verdict) for g in got} == {(i, *judged(u)) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(table.limit(0), rules).count() == 0
    hosts = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "net/es/x"), (2, "http://" + "net." * 3000 + "com"), (3, "http://" + "." * 5000 + "net/fr/")], "page_id long, url string")
    assert {(g.page_id, g.rule, g.verdict) for g in url_filter.filter_urls(hosts, rules).collect()} == {(1, "net/es/", "block"), (2, None, "allow"), (3, "net/fr/", "block")}
    assert url_filter.filter_urls(table, rules.limit(0)).filter("verdict = 'allow' and rule is null").count() == len(urls)


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.col("id").cast("string").alias("key"))
    listed = universe.filter("key % 7 = 0")
    levels = url_filter.build_cascade(listed, universe, 20000)
    assert len(levels) > 2
    keys = [str(i) for i in range(20000)]
    import pyarrow as pa

    assert url_filter.listed(levels, url_filter._prints(pa.array(keys))).tolist() == [i % 7 == 0 for i in range(20000)]
    with pytest.raises(ValueError):
        url_filter.build_cascade(listed, universe, 20000, most_bytes=100)


def test_archives(spark):
    r = random.Random(4)
    big = "".join(chr(r.randrange(32, 1000)) for _ in range(3000))
    bodies = ["", None, "x", big, big, "y" * 999, "y" * 999, "z" * 1000, "z" * 1000, "line\r\n\r\nline é", big, "\x1f\x08" * 700]
    pages = [(i, None if i == 2 else f"http://h/{i}\r\nX: é", b, "extra") for i, b in enumerate(bodies)] + [(r.randrange(100, 10**9), "u", "".join(r.choices("abcdef", k=r.randrange(5000))), "e") for _ in range(200)]
    pages += [(10, "http://h/10", big, "again"), (None, "n", "w" * 2000, "no id")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    path = new_path(spark, "warc")
    warc.write_archives(table, path)
    order = ["page_id", "digest", "refers_to"]
    assert sorted(map(str, warc.with_revisits(table).select(order).collect())) == sorted(map(str, warc.with_revisits(table, broadcast_limit=0).select(order).collect()))
    for split in (32 << 20, 777):
        got = warc.read_archives(spark, path, split_bytes=split).collect()
        assert len(got) == len(pages)
        groups = {}
        for i, _, b, _ in pages:
            if len((b or "").encode()) >= 1000 and i is not None:
                groups[b] = max(groups.get(b, i), i)
        expected = sorted((f"<urn:page:{'' if i is None else i}>", len((b or "").encode()), hashlib.sha1((b or "").encode()).hexdigest(), "revisit" if groups.get(b, i) != i else "response") for i, _, b, _ in pages)
        assert sorted((g.record_id, g.payload_bytes, g.payload_digest, g.record_type) for g in got) == expected
        body = {f"<urn:page:{i}>": (b or "").encode() for i, _, b, _ in pages}
        assert all(bytes(g.payload) == body[g.record_id] for g in got if g.record_type == "response" and g.record_id != "<urn:page:>")
        assert {g.refers_to for g in got if g.record_type == "revisit"} == {f"<urn:page:{i}>" for i in (10, 8)}
    files = [x.path.removeprefix("file:") for x in spark.read.format("binaryFile").load(path).select("path", "length").collect() if x.length]
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == len(pages)


def test_large_record_ends_with_zero():
    for size in (1 << 24) - 400, 1 << 24, (1 << 24) + 5:
        record = warc._record(1, "u", b"a" * size, hashlib.sha1(b"").hexdigest(), None)
        packed = warc.member(record) + b"\0"
        assert gzip.decompress(packed) == record
        assert warc._unpack(packed, 0, lambda n: b"")[0] == record
    assert warc._unpack(b"\x1f\x8b\x08\x00 junk and more junk", 0, lambda n: b"") is None
    assert warc._unpack(gzip.compress(b"not a record"), 0, lambda n: b"") is None
    assert base64.b32encode(b"x" * 20).decode().isupper()


def test_archives_empty(spark):
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def scan(spark, rows, **more):
    table = spark.createDataFrame([(d, t, [1]) for d, t in rows], "doc_id long, text string, matches array<int>").repartition(2)
    return license_scan.scan(table, **more).collect()


def test_licences(spark):
    r = random.Random(6)
    filler = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    rows, truth = [], {}
    for i, name in enumerate(TEMPLATES):
        rows.append((i, f"{filler(30)}.\n{TEMPLATES[name].upper()}\n{filler(20)} é"))
        truth[i] = name
    mit = TEMPLATES["MIT"].split()
    edited = [w for j, w in enumerate(mit) if j % 17 != 5]
    rows += [(100, " ".join(edited)), (101, filler(500)), (102, None), (103, ""), (104, TEMPLATES["MIT"] + "\n" + TEMPLATES["MIT"]), (105, "Released under the"), (101, filler(5))]
    got = {}
    for row in scan(spark, rows):
        got.setdefault(row.doc_id, []).extend(row.matches)
    for i, name in truth.items():
        own = [m for m in got[i] if m.template == name]
        assert len(own) == 1 and own[0].coverage == 1.0, name
        text = rows[i][1].encode()
        assert text[own[0].byte_start : own[0].byte_end].decode().translate(brute.LOWER) == TEMPLATES[name].translate(brute.LOWER).rstrip("./")
    near = [m for m in got[100] if m.template == "MIT"]
    words = lambda t: brute.leak_words(t)
    assert near[0].matched == brute.longest_common(words(TEMPLATES["MIT"]), words(rows[len(truth)][1]))
    assert got[101] == got[102] == got[103] == got[105] == []
    assert [m.template for m in got[104]].count("MIT") == 2
    assert scan(spark, []) == []


def test_alignment_is_a_longest_common_subsequence():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = r.integers(0, 5, r.integers(1, 15)), r.integers(0, 5, r.integers(1, 20))
        matched, start, end = license_scan.align(a, b, -len(a), len(b))
        assert matched == brute.longest_common(a.tolist(), b.tolist())
        assert brute.longest_common(a.tolist(), b[max(0, start) : end].tolist()) == matched


def test_licences_with_long_edits(spark):
    r = random.Random(9)
    filler = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    mit = TEMPLATES["MIT"].split()
    half = len(mit) // 2
    cut = next(i for i in range(len(mit)) if mit[i : i + 3] == ["The", "above", "copyright"])
    texts = [
        mit[:half] + filler(12) + mit[half:],
        mit[:half] + filler(len(mit) - 10) + mit[half:],
        mit[:cut] + mit[cut + 25 :],  # the condition of MIT-0 is left out
        [w for i in range(0, len(mit), 30) for w in mit[i : i + 30] + filler(40)],
    ]
    rows = [(i, " ".join(filler(50) + t + filler(50))) for i, t in enumerate(texts)]
    got = {row.doc_id: [m for m in row.matches if m.template == "MIT"] for row in scan(spark, rows)}
    whole = brute.leak_words(TEMPLATES["MIT"])
    for i, text in rows:
        assert [m.matched for m in got[i]] == [brute.longest_common(whole, brute.leak_words(text))], i
    assert [got[i][0].coverage for i in (0, 1, 3)] == [1.0] * 3 and 0.8 < got[2][0].coverage < 0.9


def test_licences_side_by_side(spark):
    r = random.Random(10)
    notice, mit = TEMPLATES["MIT notice"], TEMPLATES["MIT"]
    rows = [
        (0, f"{notice} {notice}"),
        (1, " ".join([notice] * 500)),
        (2, " ".join([TEMPLATES["all rights reserved"]] * 300)),
        (3, " ".join(f"{notice} w{r.randrange(99)}" for _ in range(100)) + " Released under the Released under the MIT License"),
        (4, " ".join([mit] * 70)),
        (5, f"Released under the MIT {notice}"),
    ]
    names = ["MIT notice", "MIT notice", "all rights reserved", "MIT notice", "MIT", "MIT notice"]
    got = {row.doc_id: sorted((m.start, m.end, m.coverage) for m in row.matches if m.template == names[row.doc_id]) for row in scan(spark, rows)}
    assert {i: len(own) for i, own in got.items()} == {0: 2, 1: 500, 2: 300, 3: 101, 4: 70, 5: 2}
    assert all(x[1] <= y[0] for own in got.values() for x, y in zip(own, own[1:]))
    assert got[1] == [(5 * i, 5 * i + 5, 1.0) for i in range(500)] and got[2] == [(3 * i, 3 * i + 3, 1.0) for i in range(300)]


def test_licences_against_a_search_without_index(spark):
    """What a search over all templates and all places finds, if it has a run of w + k - 1 equal words, is found; nothing else is."""
    r = random.Random(12)
    templates = {f"t{i}": " ".join(f"w{r.randrange(60)}" for _ in range(n)) for i, n in enumerate([6, 9, 12, 15, 18])}
    rows = []
    for i in range(60):
        w = [f"w{r.randrange(60)}" for _ in range(r.randrange(0, 30))]
        for _ in range(r.randrange(0, 3)):
            t = r.choice(list(templates.values())).split()
            for _ in range(r.randrange(0, 5)):
                at = r.randrange(len(t))
                t[at : at + r.randrange(0, 2)] = [f"x{r.randrange(9)}"] * r.randrange(0, 2)
            w += t + [f"w{r.randrange(60)}" for _ in range(r.randrange(0, 10))]
        rows.append((i, " ".join(w)))
    likely, possible = set(), set()
    for i, text in rows:
        w = text.split()
        for name, template in templates.items():
            t = template.split()
            runs = {tuple(t[j : j + 6]) for j in range(len(t) - 5)}
            for at in range(len(w)):
                part = w[at : at + 2 * len(t)]
                if brute.longest_common(t, part) >= 0.8 * len(t):
                    possible.add((i, name))
                    if any(tuple(part[j : j + 6]) in runs for j in range(len(t))):
                        likely.add((i, name))
    found = {(row.doc_id, m.template) for row in scan(spark, rows, templates=templates) for m in row.matches}
    assert likely <= found <= possible and len(likely) > 20


def test_licence_spans_that_overlap():
    found = [(5, 10 * i, 10 * i + 8) for i in range(100)]
    assert license_scan._apart([*found, (4, 3, 8), (4, 4, 12), (5, 8, 10), (3, 985, 999)]) == [(5, 0, 8), (5, 8, 10), *found[1:]]


def double_scores(rows, q):
    """Inner products as double precision has them, NaN last, ties to the smaller id."""
    out = []
    for i, v in rows.items():
        if i != q:
            total = 0.0
            for a, b in zip(rows[q], v, strict=True):
                total += a * b
            out.append((total != total, -total, i))
    return sorted(out, key=lambda x: (x[0], x[1] if x[1] == x[1] else 0.0, x[2]))


@pytest.mark.parametrize("k", [5, 30])
def test_vectors_of_any_length(spark, k):
    """Lengths from 1e-300 to 1e300, alone and mixed, and products that are all negative: no row is lost."""
    r = np.random.default_rng(2)
    groups = [("tiny", lambda: 1e-200, 0), ("small", lambda: 1e-60, 1), ("large", lambda: 1e39, 2), ("mixed", lambda: 10.0 ** r.uniform(-300, 300), 3), ("plain", lambda: 10.0 ** r.uniform(-20, 20), 4)]
    for name, size, group in groups:
        rows = {i: (r.standard_normal(16) * size()).tolist() for i in range(150 if group else 60)}
        rows |= {1000: rows[3], 1001: [-x for x in rows[0]], 1003: [x * 1e-3 for x in rows[20]]}
        if name == "large":
            rows = {0: [1e39] * 16, **{i: [-1e39 * (1 + i % 3)] * 16 for i in range(1, 10)}}  # nine candidates, all of them opposite
        index = vector_search.build_index(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(3))
        got = vector_search.search(index, index.filter("vec_id % 20 = 0"), k).collect()
        want, hit = 0, 0
        for q in (i for i in rows if i % 20 == 0):
            expected = double_scores(rows, q)[:k]
            own = sorted((g["rank"], g.vec_id, g.score) for g in got if g.query_id == q)
            assert [x[0] for x in own] == list(range(1, len(expected) + 1))  # complete
            want, hit = want + len(expected), hit + len({x[1] for x in own} & {x[2] for x in expected})
            places = [(s != s, -s if s == s else 0.0, i) for _, i, s in own]
            assert places == sorted(places)
        assert hit >= 0.99 * want, name


def test_urls_ties_and_clashing_columns(spark):
    rules = spark.createDataFrame([("b.com", "/x", "block"), ("com", "/xyz", "allow"), ("É.com", "/", "block")], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.b.com/xyz", 5, 6), (2, "http://a.com/xyz", 5, 6), (3, "http://É.com/", 5, 6), (4, "http://é.com/", 5, 6)], "page_id long, url string, __keys int, _keys int")
    got = {g.page_id: (g.rule, g.verdict, g["__keys"]) for g in url_filter.filter_urls(urls, rules).collect()}
    assert len("b.com/x") == len("com/xyz") and got[1] == ("b.com/x", "block", 5)  # as long: the host with more labels
    assert got[2] == ("com/xyz", "allow", 5) and got[3] == ("É.com/", "block", 5) and got[4] == (None, "allow", 5)


def test_licence_chains_by_place():
    """Chains equal those of a plain step for each hit, ties included."""
    r = np.random.default_rng(3)
    for n, size, step, loss, pairs in ((0, 9, 3, 0.2, 50), (1, 9, 3, 0.2, 50), (90, 9, 3, 0.2, 50), (300, 30, 4, 1e-6, 1 << 19), (300, 12, 4, 0.2, 7)):
        at, place = np.sort(r.integers(0, 2 * n + 1, n)), r.integers(0, size, n)
        order = np.lexsort((place, at))
        at, place = at[order], place[order]
        worth, before = [float(step)] * n, [-1] * n
        for i in range(n):
            for j in range(i - 1, -1, -1):
                down, along = int(place[i] - place[j]), int(at[i] - at[j])
                more = along - down
                if down > 0 and 0 < along <= 2 * size and more <= size:
                    value = worth[j] + min(down, along, step) - (loss * more if more > 0 else -1e-6 * more)
                    if value > worth[i]:
                        worth[i], before[i] = value, j
        license_scan.PAIRS, kept = pairs, license_scan.PAIRS
        try:
            chains = license_scan._chains(at, place, size, step, loss)
        finally:
            license_scan.PAIRS = kept
        assert {i for c in chains for i in c.tolist()} == set(range(n))
        for chain in chains:
            assert before[chain[0]] == -1 and [before[i] for i in chain[1:].tolist()] == chain[:-1].tolist()


def test_licence_time_of_repetitive_texts():
    index, mit = license_scan.Index(TEMPLATES), TEMPLATES["MIT"]
    phrase = "permission is hereby granted free of charge "
    for text, most in ((phrase * 12500, 1.0), (phrase * 1500 + mit + " " + phrase * 1500, 3.0)):
        words, *_ = license_scan._hashes(pa.array([text]))
        begin = time.process_time()
        found = license_scan.matches(index, words, license_scan.fp.grams(words, 3), 8, 0.8)
        assert time.process_time() - begin < most  # a step for each hit took 11 s for the first
        assert ("MIT" in [index.names[m[0]] for m in found]) == (mit in text)
