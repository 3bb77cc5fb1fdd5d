"""Suffix dedup, Jaccard groups, decontamination and components against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from joblore.llm import components, jaccard_join, suffix_dedup
from joblore.llm.components import connected_components
from joblore.llm.decontamination import contamination
from joblore.llm.jaccard_join import choose_boundary, jaccard_groups, subset_count, subset_sizes
from joblore.llm.suffix_dedup import remove_repeats
from tests.llm import brute

SCHEMA = "doc_id long, text string, batch string, rest int, n_bytes int, row int, score double"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2, 3, 0.5) for d, t in rows], SCHEMA).repartition(3)


def prose(r, n, vocabulary=40):
    return " ".join(f"w{r.randrange(vocabulary)}é" if r.random() < 0.2 else f"w{r.randrange(vocabulary)}" for _ in range(n))


def near_copies(seed):
    """Texts with passages in common, exact and near copies, tiny and empty ones."""
    r = random.Random(seed)
    base = [prose(r, r.randrange(5, 120), 60) for _ in range(12)]
    passage = prose(r, 30)
    texts = list(base)
    for b in base[:6]:
        for _ in range(6):
            w = b.split()
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = f"new{r.randrange(99)}"
            texts.append(" ".join(w))
    texts += [prose(r, 20) + " " + passage + " " + prose(r, 20) for _ in range(6)]
    texts += ["", None, " \n\t", "a", "a b", "A B", "a b c", "a b c d", "x " * 300, "é" * 200, "ê" * 200, base[0], base[0]]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("length", "piece"), [(50, 1 << 20), (20, 1 << 20), (200, 1 << 20), (50, 300), (16, 40)])
def test_repeats(spark, length, piece, monkeypatch):
    """A piece of few bytes cuts nearly all texts, as very long ones are cut."""
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    docs = near_copies(1)
    got = remove_repeats(table(spark, docs), length=length, batch_bytes=2000, carry=("batch",)).collect()
    expected = brute.repeats(docs, length)
    assert len(got) == len(docs)
    for row in got:
        n, removed, spans, kept = expected[row.doc_id]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
        assert row.rest.batch == "x" and len(row.text.encode()) >= len(kept)


def test_batches_of_clustered_ids(spark):
    """Batches have about equal bytes however unevenly ids are spread, and a repeated id stays in one."""
    ids = [c * 10**12 + i for c in range(50) for i in range(40)] + [7] * 30
    docs = spark.createDataFrame([(i, "x" * 100) for i in ids], "doc_id long, text string").withColumn("rest", F.lit(None).cast("string"))
    got = {r.batch: (r.n, r.low, r.high) for r in suffix_dedup._batches(docs, 203_000, 2000).groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()}
    sizes = sorted(n for n, _, _ in got.values())
    assert len(got) >= 100 and sizes[-1] <= 50 and sizes[-2] <= 20
    order = [got[b] for b in sorted(got)]
    assert all(x[2] < y[1] for x, y in zip(order, order[1:], strict=False))


#: Two words that any polynomial hash modulo a power of two takes for one.
TWINS = ["".join("ab"[(i.bit_count() + turn) % 2] for i in range(1024)) for turn in (0, 1)]


def test_self_similar_words(spark):
    docs = table(spark, list(enumerate(TWINS, 1)))
    assert {(r.doc_id, r.component_id) for r in jaccard_groups(docs).collect()} == {(1, 1), (2, 2)}
    items = spark.createDataFrame([(1, TWINS[1])], "item_id long, text string")
    assert {(r.doc_id, r.n_hit) for r in contamination(docs, items).collect()} == {(1, 0), (2, 1)}
    expected = brute.repeats(list(enumerate(TWINS, 1)), 50)
    assert {(r.doc_id, r.n_removed) for r in remove_repeats(docs).collect()} == {(d, x[1]) for d, x in expected.items()}


def test_repeats_edges(spark):
    same = "0123456789" * 12
    rows = [(5, same), (5, same), (None, same), (7, None), (9, "x" * 49), (8, "x" * 49)]
    got = {(r.doc_id, r.n_removed) for r in remove_repeats(table(spark, rows)).collect()}
    assert got == {(5, 0), (None, 0), (7, 0), (8, 0), (9, 0)}  # neither the id's own copy nor a row without id removes
    assert remove_repeats(table(spark, [])).count() == 0
    assert remove_repeats(table(spark, [(3, same), (4, same)])).filter("n_removed = 120 and n_spans = 1 and text = ''").count() == 1


@pytest.mark.parametrize(("n", "num", "seed"), [(3, 90, 2), (5, 80, 3), (2, 60, 4)])
def test_jaccard_groups(spark, n, num, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    docs = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, docs), ngram=n, num=num, frequent_from=5).collect()}
    assert got == brute.components(docs, n, num, 100)


def test_jaccard_hot_group(spark):
    """Many near copies of one text, most further than the threshold from each other."""
    r = random.Random(9)
    base = [f"t{i}" for i in range(60)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(1, 4)):
            w[r.randrange(60)] = f"v{r.randrange(1000)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, docs)).collect()}
    assert got == brute.components(docs, 3, 90, 100)


@pytest.mark.parametrize("n", [150, 600])
def test_jaccard_apart(spark, n, monkeypatch):
    """Texts of which all pairs are near the threshold and none links: rows grow with the texts, not with pairs,
    and so do those with texts or sketches that are dealt out for comparing."""
    made, dealt = [], []
    real, blocks = jaccard_join.stash, jaccard_join._in_blocks
    monkeypatch.setattr(jaccard_join, "stash", lambda df, name, **options: (made.append((name, real(df, name, **options))), made[-1][1])[1])
    monkeypatch.setattr(jaccard_join, "BLOCK", 100)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 32)
    monkeypatch.setattr(jaccard_join, "_in_blocks", lambda whole, split, *rest: (dealt.append((whole, split)), blocks(whole, split, *rest))[1])
    base = [f"t{i}" for i in range(150)]
    docs = [(i, " ".join(base[: 9 * (i % 16)] + [f"v{i}"] + base[9 * (i % 16) + 1 :] + [f"z{i}" * (1 + i % 3)] * 3)) for i in range(n)]
    docs += [(n, docs[0][1] + " end"), (n + 1, docs[0][1] + " end more")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, docs), ngram=5, num=90).collect()}
    assert got == brute.components(docs, 5, 90, 100)
    assert max(t.count() for _, t in made if set(t.columns) == {"a", "b"}) <= 8 * n
    assert {"text", "sketch"} & {c for _, split in dealt if split is not None for c in split.columns} == {"text", "sketch"}
    rows, named = sum(x.count() for pair in dealt for x in pair if x is not None), sum(t.count() for name, t in made if name == "tiles")
    assert rows <= 3 * n and 0 < named <= n


def test_jaccard_repeated_ids(spark):
    """The smallest set of a repeated id counts, in any order of its rows."""
    a, b = "a b c d e f g h i j k l m", "q r s t u v w x y z a b c d"
    for rows in ([(5, a), (5, b), (6, b + " more"), (7, a)], [(5, b), (7, a), (6, b + " more"), (5, a)]):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, rows), num=80).collect())
        assert got == [(5, 11, 5), (5, 12, 5), (6, 13, 6), (7, 11, 5)]


def test_jaccard_edges(spark):
    assert jaccard_groups(table(spark, [])).count() == 0
    rows = [(3, "a b c d"), (3, "a b c d"), (2, "A b  C d"), (None, "a b c d"), (1, None), (0, "")]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, rows)).collect())
    assert [(k[1], n, c) for k, n, c in got] == [(0, 0, 0), (1, 0, 1), (2, 2, 2), (3, 2, 2), (3, 2, 2), (0, 2, None)]


def test_boundary():
    assert subset_sizes(10, 90, 100) == [9, 10] and subset_count(10, 90, 100) == 11
    assert choose_boundary({5: 100, 10: 100}, 50.0, 90, 100) >= 10
    assert choose_boundary({30: 100}, 1.0, 90, 100) == 0
    assert choose_boundary({}, 1.0, 90, 100) == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_contamination(spark, limit):
    r = random.Random(5)
    items = [(i, prose(r, n, 30)) for i, n in enumerate([25, 10, 11, 3, 1, 9, 0, 40])] + [(100, None), (101, "?!"), (None, "only here and nowhere else in any of these texts my friend"), (1, "second text of item one with more than ten words in it now")]
    docs = []
    for i in range(40):
        text = prose(r, r.randrange(0, 60), 5000)
        if i % 3 == 0:
            w = items[r.randrange(8)][1].upper().split()
            text += " - " + ", ".join(w[r.randrange(3) :]) + " " + prose(r, 5, 5000)
        docs.append((i, text))
    docs += [(50, None), (51, ""), (52, items[-2][1]), (52, "nothing at all"), (None, items[1][1]), (53, "W1\x00w2")]
    t = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(table(spark, docs), t, broadcast_limit=limit).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    out = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=key)
    assert out == sorted(brute.leaks(docs, items), key=key)
    for row in got:
        assert row.n_items == len(row["items"]) and row.contaminated == (row.n_hit > 0)
        assert row.items_sha256 == hashlib.sha256(",".join(row["items"]).encode()).hexdigest()


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(table(spark, [(1, "a b c")]), none).filter("not contaminated and n_words = 3").count() == 1
    assert contamination(table(spark, []), none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (1, 2), (2, 3), (3, 1), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 2: 1, 3: 1}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = spark.range(1, 500).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert connected_components(star).filter("component = 0").count() == 500


@pytest.mark.parametrize(("few", "most"), [(1000, 1), (20, 100)])
def test_components_of_few_edges(spark, few, most, monkeypatch):
    """Few edges are written once and joined in one task, more go by rounds; both ways give the same."""
    made, real = [], components.stash
    monkeypatch.setattr(components, "stash", lambda df, name: (made.append(name), real(df, name))[1])
    monkeypatch.setattr(components, "FEW", few, raising=False)
    r = random.Random(6)
    edges = [(100 - i, 99 - i) for i in range(60)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(5, None), (5, 5)]
    expected = {}
    for a, b in edges[:-2]:
        if a != b:
            group = expected.get(a, {a}) | expected.get(b, {b})
            expected |= dict.fromkeys(group, group)
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert sorted(got.collect()) == sorted((x, min(group)) for x, group in expected.items())
    assert len(made) <= most
