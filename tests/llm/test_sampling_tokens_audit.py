"""Importance resampling, token files and the audit of filters against plain versions."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from joblore.llm import token_store
from joblore.llm.filter_audit import failure_counts, filter_audit
from joblore.llm.fingerprints import pieces
from joblore.llm.importance import features, importance_resample
from joblore.llm.scratch import new_path
from tests.llm.brute import leak_words

FILE = public_tokenizers.path("word_bpe_49k.json")


def resampled(docs, target, percent=25, max_n=2, buckets=10_000, least=20, seed=7):
    """The rows of docs [(doc_id, text)] as (doc_id, n_features, weight, score, rank), by loops."""
    runs = lambda t: [" ".join(w[i : i + n]) for w in [leak_words(t)] for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x)) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        own = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in map(bucket, runs(text))]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(leak_words(text))])
    long = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(long[: len(long) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("max_n, percent", [(1, 100), (2, 25), (3, 50)])
def test_importance(spark, max_n, percent):
    random.seed(max_n)
    words = ["The", "cat", "naïve", "x9", "über", "of", "it's", "中文", "ZZ", "q"]
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " ,.! "), (203, "one"), (204, "\x00a\x7fb É"), (205, "word " * 30_000), (None, "the cat " * 12), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(300 + i, "same text again " * 9) for i in range(40)]
    target = ["the cat of über", None, "", "naïve x9 q q"]
    table = spark.createDataFrame([(i, t, 0, 1.0) for i, t in docs], "doc_id long, text string, n_words int, rank double").repartition(5)
    got = importance_resample(table, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, max_n=max_n)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(resampled(docs, target, percent, max_n), key=key)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("texts", [["Abc def", "XYZ longer text here", "é B", "", "Tail One", "Two"], ["Abc", None, "Def GHI", "jkl", None, "M n O"]])
def test_features_of_cut_batches(texts, kind):
    whole = pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"])
    for limit in (1, 8, 1000):  # bytes of a piece
        for first in range(len(texts)):
            at = first
            for piece in pieces(iter([whole.slice(first)]), "text", limit):
                own = texts[at : at + piece.num_rows]
                at += piece.num_rows
                n_words, runs = features(piece.column("text"), 2, 10_000)
                assert n_words.tolist() == [len(leak_words(t)) for t in own]
                got = sorted((int(o), int(b)) for buckets, owners in runs for b, o in zip(buckets, owners, strict=True))
                spelled = [(i, w[j : j + n]) for i, w in enumerate(map(leak_words, own)) for n in (1, 2) for j in range(len(w) - n + 1)]
                assert got == sorted((i, zlib.crc32(" ".join(x).encode()) % 10_000) for i, x in spelled)
            assert at == len(texts)


def test_importance_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a " * 20), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance_resample(none, docs).count() == 0
    assert sorted((r.doc_id, r.rank) for r in importance_resample(docs, none, percent=100).collect()) == [(1, 1), (2, None)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**63 - 1)), max_size=700))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.int64))
    own = token_store.EliasFano(token_store.EliasFano.encode(values))
    assert own.all().tolist() == values.tolist() and own.select(np.arange(len(values))[::-1]).tolist() == values[::-1].tolist()
    for x in [*values[:3].tolist(), 17]:
        assert own.find(x) == (np.searchsorted(values, x), np.searchsorted(values, x, "right"))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).geometric(1 / 500, 50_000))
    assert len(token_store.EliasFano.encode(values)) * 8 / len(values) < 2 + math.log2(500) + 0.6


def test_encoder_gives_whole_texts_ids():
    random.seed(3)
    parts = [*"ab' seTŞ́̂ é각Σ1.,;:!?İH̱\n\t <|>\x00\u0085", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'S", "<|startoftext|>.", "don't", "中文"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(5000)] + [None, "", "x" * 5000, "é" * 3000]
    for file, by_word in ((FILE, True), (public_tokenizers.path("byte_bpe_50k.json"), False)):
        plain, own = Tokenizer.from_file(file), token_store.Encoder(file)
        assert own.by_word == by_word
        own.KEPT = 50  # generations change
        for first in range(0, len(texts), 700):
            some = texts[first : first + 700]
            ids, n = own(pa.array(some, pa.string()))
            got = np.split(ids, np.cumsum(n)[:-1])
            assert [x.tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in some]


def test_separable_is_told_from_the_rules():
    with open(FILE, encoding="utf-8") as f:
        held = json.load(f)
    assert token_store.separable(held)
    assert not token_store.separable(held | {"normalizer": None})
    assert not token_store.separable(held | {"post_processor": {"type": "x"}})


def test_token_files(spark):
    random.seed(4)
    docs = [(i * 7 - 300, " ".join(random.choices(["Alpha", "beta,", "Gamma's", "δ", "\n"], k=random.randint(0, 30)))) for i in range(300)]
    docs += [(None, "no id"), (None, None), (9999, None), (10_000, ""), (5, "again"), (5, "again"), (5, "Other"), (2**62, "far"), (-(2**62), "far below"), (77_777, "long text " * 20_000)]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int").repartition(6)
    path = new_path(spark, "tokens")
    token_store.write_tokens(table, path, block_bytes=2000, block_docs=40)
    plain = Tokenizer.from_file(FILE)
    expected = [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in docs]
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert [g.doc_id for g in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    assert sorted((str(g.doc_id), g.ids) for g in got) == sorted((str(i), ids) for i, ids in expected)
    start = 0
    for g in got:
        assert (g.start, g.n_tokens) == (start, len(g.ids)) and g.ids_crc32 == zlib.crc32(np.array(g.ids, "<u4").tobytes())
        start += len(g.ids)
    assert token_store.read_tokens(spark, path, with_ids=False).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = {g.start: g for g in got}
    few = token_store.lookup(spark, path, [5, 77_777, -(2**62), 2**62, 10_000, 123_456]).collect()
    assert Counter(r.doc_id for r in few) == {5: 3 + sum(i == 5 for i, _ in docs[:300]), 77_777: 1, -(2**62): 1, 2**62: 1, 10_000: 1}
    assert all(whole[r.start].doc_id == r.doc_id and whole[r.start].ids == r.ids for r in few)
    blocks = token_store.manifest(spark, path).orderBy("start").collect()
    assert len(blocks) > 8 and all(b.n_docs <= 40 for b in blocks)


def test_token_files_of_nothing(spark):
    path = new_path(spark, "tokens")
    token_store.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_store.read_tokens(spark, path).count() == 0 and token_store.lookup(spark, path, [1]).count() == 0


def test_a_damaged_file_is_refused(tmp_path):
    ids, ends = np.array([3, 9], np.int64), np.array([1, 3], np.int64)
    data = token_store.block(2, 0, 0, 0, ids, ends, [np.array([2, 5, 2], "<u2").tobytes()], 0) + b"\0"
    (tmp_path / "a").write_bytes(data)
    own = token_store.Block(f"file://{tmp_path}/a")
    assert own.bounds(1) == (1, 3) and own.tokens(1, 3).tolist() == [5, 2] and list(own.rows_of(9)) == [1]
    for name, bad in (("b", data[:-3]), ("c", b"x" + data[1:]), ("d", data[:10])):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(ValueError):
            token_store.Block(f"file://{tmp_path}/{name}")


def audited(docs, labels):
    """{(part, order, step): counts} by running every order over every document."""
    known: dict = {}
    for i, q, t in labels:
        known[i] = tuple(max(a or 0, b or 0) for a, b in zip(known.get(i, (0, 0)), (q, t), strict=True))
    failed = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        failed.append((lang or "", fails, known.get(i, (0, 0)) if i is not None else (0, 0)))
    out = {}
    for part in {p for p, _, _ in failed}:
        own = [(f, k) for p, f, k in failed if p == part]
        shapley: Counter = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = [next((s for s, x in enumerate(order, 1) if f[x]), 9) for f, _ in own]
            for step, x in enumerate(order, 1):
                shapley[x] += gone.count(step)
                out[part, order, step] = [
                    sum(g > step for g in gone), gone.count(step), sum(f[x] and g < step for (f, _), g in zip(own, gone, strict=True)), sum(f[x] and sum(f.values()) == 1 for f, _ in own),
                    sum(g == step and k[0] == 1 for (_, k), g in zip(own, gone, strict=True)), sum(g == step and k[1] == 1 for (_, k), g in zip(own, gone, strict=True)), x,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    random.seed(5)
    texts = [" ".join(random.choice(["Word", "x", "#", "ONE", f"w{random.randint(0, 200)}"]) for _ in range(random.choice([0, 5, 99, 100, 140]))) for _ in range(25)] + [None, "", "  ", "É" * 10, "A" * 10 + "a" * 90, " ".join(f"v{i}" for i in range(120))]
    docs = [(i, random.choice(texts), random.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(3, docs[3][1], "en"), (3, docs[3][1], docs[3][2]), (None, texts[0], "en"), (None, None, None), (900, "once " * 20_000, "long")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (7777, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, quality int, mask string").repartition(4)
    got = filter_audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == audited(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_filter_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, "c", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    own = {"S": lambda text, words: words[0] == "c"}
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in filter_audit(docs, labels, own, "R").collect()} == {("SR", 1): (2, 1, 2), ("SR", 2): (1, 1, 2), ("RS", 1): (2, 1, 2), ("RS", 2): (1, 1, 2)}
    assert filter_audit(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        filter_audit(docs, labels, own, "S")
    assert sum(r.n for r in failure_counts(docs, labels).collect()) == 3
