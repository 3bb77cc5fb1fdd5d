"""SentencePiece against a plain search and the public library; classifiers by held-out accuracy."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joblore.llm import rule_ensemble, sentencepiece, text_cnn
from joblore.llm.labels import training_rows
from joblore.llm.sentencepiece import MODEL, SPACE, combine, crossings, decode, encode, entries, model_bytes, normal, scan, transfer, vocabulary

needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="the vocabulary file is not here")


def texts(seed=1):
    r = random.Random(seed)
    words = ["the", "Hello", "world", "naïve", "Straße", "éèç", "tion", "ing", "x" * 40, "漢字", "a\u0001b", "12345", "http://a.b/c?d", "don't", "  ", "\n", "\t", "🙂"]
    out = [None, "", " ", "   ", "a", " lead", "trail ", "\n", "a▁b", "x" * 500, "word" * 300]
    out += [" ".join(r.choices(words, k=r.randrange(1, 60))) for _ in range(30)]
    return out + ["".join(r.choices("abcdefgh tion", k=900)), "".join(r.choices(words, k=200))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 9) for i, t in enumerate(rows)], "doc_id long, text string, row string, ids int").repartition(3)


def whole(v, text):
    """One plain search over the whole text: its score and ids; of ties, the longest last piece."""
    text = normal(text or "")
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        ways = []
        for start in range(max(0, end - v.longest), end):
            found = v.scores.get(text[start:end], (v.unknown_score, -1) if end - start == 1 else None)
            if found:
                ways.append((best[start][0] + found[0], start))
        best.append(max(ways, key=lambda w: (w[0], -w[1])))
    ids, end = [], len(text)
    while end:
        start = best[end][1]
        piece = text[start:end]
        ids[:0] = [v.scores[piece][1]] if piece in v.scores else [v.byte_ids.get(b, v.unknown) for b in piece.encode()]
        end = start
    return best[-1][0], ids


@needs_model
@pytest.mark.parametrize("giant", [1 << 16, 100])
def test_encode(spark, giant):
    v, rows = vocabulary(model_bytes(MODEL)), texts()
    got = decode(encode(frame(spark, rows), giant=giant, chunk=64)).collect()
    assert len(got) == len(rows)
    for row in got:
        score, ids = whole(v, rows[row.doc_id])
        assert (row.score, row.ids) == (score, ids)  # on both paths
        assert row.decoded == (rows[row.doc_id] or "").replace(SPACE, " ")
    assert encode(frame(spark, [])).count() == 0


@needs_model
def test_decode_edges(spark):
    ids = vocabulary(model_bytes(MODEL)).scores[SPACE + "the"][1]
    rows = spark.createDataFrame([(0, None), (1, []), (2, [ids, None, -5, 10**6, ids])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode(rows).collect()} == {0: None, 1: "", 2: "the the"}


@needs_model
def test_library_agrees():
    """The public library, told to segment by total score, finds the same ids."""
    import sentencepiece as library

    with open(MODEL, "rb") as file:
        model = file.read()
    at = model.rfind(b"\x18\x02 \x80\xfa\x01")  # model type BPE, then the size of the vocabulary
    processor = library.SentencePieceProcessor(model_proto=model[:at] + b"\x18\x01" + model[at + 2 :])
    v, r = vocabulary(model), random.Random(2)
    for _ in range(200):
        text = " ".join("".join(r.choices("etaoinshrdlucmfw", k=r.randrange(1, 9))) for _ in range(4))
        score, ids = whole(v, text)
        other = processor.encode(text)
        assert sum(v.scores[v.pieces[i]][0] for i in other) == score
        assert processor.decode(ids) == text == v.decode(ids)


@needs_model
def test_transfer_matrices():
    v = vocabulary(model_bytes(MODEL))
    for plain in ("international" * 6, "some words and others " * 4):
        text, cuts = normal(plain), [0, 20, 40, 60, len(plain) + 1]
        chunks = [(text[max(0, a - v.longest + 1) : b], min(a, v.longest - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
        parts = [transfer(v, *c) for c in chunks]
        every = [m for m in scan(parts)]
        left = parts[0]
        for m, out in zip(parts[1:], every[1:], strict=True):
            left = combine(left, m)
            assert np.array_equal(left, out)
        assert every[-1][0, 0] == whole(v, plain)[0]
        state = np.full(v.longest, -np.inf)
        state[0] = 0
        maps = [entries(v, *c, s) for c, s in zip(chunks, [state, *(m[0] for m in every)], strict=False)]
        assert crossings(maps)[-1] == 0


@needs_model
def test_long_words_and_chunks_of_any_text():
    """Words of thousands of characters and chunks without borders, by grains and by a plain search: ids, scores and states."""
    v, r = vocabulary(model_bytes(MODEL)), random.Random(7)
    joined = "".join(r.choices([p for p in v.scores if p.isalpha() and p.isascii() and len(p) > 3], k=400))
    plain = ["x" * 700, "".join(r.choices("abcdefghtion", k=1500)), "".join(r.choices("漢字国日本語学習a", k=900)), joined, joined[:900] + " " + joined[:300] + "🙂" * 300]
    data = [normal(t).encode() for t in [*plain, "short"]]
    ids, count, score = v.best(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data])))
    for text, own, total in zip([*plain, "short"], np.split(ids, np.cumsum(count)[:-1]), score, strict=True):
        assert (total, own.tolist()) == whole(v, text)
    for text in plain:
        text = normal(text)
        cuts = [*range(0, len(text), 300), len(text)]
        chunks = [(text[max(0, a - v.longest + 1) : b], min(a, v.longest - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert scan([transfer(v, *c) for c in chunks])[-1][0, 0] == whole(v, text[1:])[0]


@needs_model
@pytest.mark.parametrize("kind", ["spaced", "chinese", "letters", "lone"])
def test_time_of_unusual_texts(kind):
    """Matrix, entries and trace of giant texts, and one word of 60,000 characters, stay within seconds a megabyte."""
    v, r = vocabulary(model_bytes(MODEL)), random.Random(8)
    words = [p for p in v.scores if p.isalpha() and p.isascii()]
    text = {"spaced": " ".join(r.choices(words, k=9000)), "chinese": "".join(r.choices("的一是不了人我在有他这为之大来以个中上们", k=60000)), "letters": "".join(r.choices("ABCDEFGHabcdefgh01234567+/", k=60000))}.get(kind, "x" * 60000)
    text, begin = normal(text), time.process_time()
    state = np.full(v.longest, -np.inf)
    state[0] = 0
    for at in range(0, len(text), 16384):
        own = (text[max(0, at - v.longest + 1) : at + 16384], min(at, v.longest - 1))
        entries(v, *own, state)
        state = (state[:, None] + transfer(v, *own)).max(axis=0)
    data = text.encode()
    assert v.best(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[2][0] == state[0]
    assert time.process_time() - begin < len(data) * 12e-6  # a Python step for each character took up to 60e-6


def labelled(spark, n=600, seed=4):
    """Texts with planted marks: insults make toxic, symbols and repetition make bad quality."""
    r = random.Random(seed)
    bad = {"en": ["idiotic", "scummy"], "de": ["lumpenhaft", "lumpenart"]}
    common = {"en": "the of and to in is that it", "de": "der die und das ist nicht ein zu"}
    rows = []
    for i in range(n):
        lang = r.choice(["en", "de"])
        w = [r.choice(common[lang].split()) if r.random() < 0.3 else "".join(r.choices("abcdeilnorst", k=r.randrange(3, 9))) for _ in range(r.randrange(20, 120))]
        toxic, poor = int(r.random() < 0.3), int(r.random() < 0.4)
        if toxic:
            w[r.randrange(len(w))] = r.choice(bad[lang])
        if poor:
            w = [x + r.choice(["***", "###", "$$$"]) for x in w]
        rows.append((i, " ".join(w), lang, 1 - poor, toxic))
    docs = spark.createDataFrame([(i, t, lang, 0.1, 1) for i, t, lang, _, _ in rows], "doc_id long, text string, lang string, score double, label int").repartition(3)
    return docs, spark.createDataFrame([(i, q, t, "c") for i, _, _, q, t in rows] + [(0, None, None, "c"), (99999, 1, 1, "c")], "doc_id long, quality int, toxic int, text string")


def accuracy(scored, labels, label):
    own = scored.join(labels.select("doc_id", label).dropna(), "doc_id").filter("held_out")
    return own.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0], own.count()


def test_quality(spark):
    docs, labels = labelled(spark)
    scored = rule_ensemble.quality_scores(docs, labels)
    right, n = accuracy(scored, labels, "quality")
    assert n > 80 and right >= 0.97
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0
    assert scored.filter(F.col("predicted") != (F.col("score") >= 0.7).cast("int")).count() == 0
    model = rule_ensemble.train(docs, labels)
    assert model.rules and all(len(r.terms) <= 3 and r.weight for r in model.rules)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    scored = text_cnn.toxicity_scores(docs, labels)
    right, n = accuracy(scored, labels, "toxic")
    assert n > 80 and right >= 0.95
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0


@pytest.mark.parametrize("job", [rule_ensemble.quality_scores, text_cnn.toxicity_scores])
def test_classifier_edges(spark, job):
    docs, labels = labelled(spark, 80)
    odd = spark.createDataFrame([(None, "text", "en", 0.0, 1), (5, None, "en", 0.0, 1), (6, "", "en", 0.0, 1), (6, "", "en", 0.0, 1), (7, "word " * 50000, None, None, None)], docs.schema)
    got = job(docs.unionByName(odd), labels).collect()
    assert len(got) == 85 and all(0 <= r.score <= 1 for r in got) and sum(r.doc_id is None and not r.held_out for r in got) == 1
    assert {r.score for r in job(docs, labels.limit(0)).collect()} == {0.5}
    assert job(docs.limit(0), labels).count() == 0
    one = labels.filter("quality = 1 and toxic = 1")
    assert job(docs, one).count() == 80


def test_scores_do_not_depend_on_other_columns(spark):
    docs, labels = labelled(spark, 200)
    model = text_cnn.train(docs, labels)
    table = docs.orderBy("doc_id").select("text").toArrow()["text"].combine_chunks()
    at_once = model.scores(table)
    one_by_one = np.concatenate([model.scores(pa.array([t])) for t in table.to_pylist()])
    assert np.allclose(at_once, one_by_one, atol=1e-5)
    changed = docs.withColumns({"lang": F.lit("xx"), "label": F.lit(0)})
    a, b = ({r.doc_id: r.score for r in text_cnn.with_toxicity(d, model).collect()} for d in (docs, changed))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-5 for i in a)  # sums in single precision


def test_statistics_are_finite(spark):
    rows = spark.createDataFrame([("",), (" ",), ("\n\n",), ("a",), ("$",), ("É" * 10,)], "text string")
    out = rows.select(*(c.cast("double").alias(n) for n, c in rule_ensemble.statistics(F.col("text")).items())).collect()
    assert all(np.isfinite(list(r)).all() for r in out)
    assert sentencepiece.borders(normal("a  b c")) == [2, 5]


def mixed(spark, n=2400, seed=8):
    """One text in seven is toxic and of bad quality. A mark tells the clear ones; vague ones all bear another, whatever their label."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rare = int(r.random() < 1 / 7)
        w = ["".join(r.choices("abcdeilnorst", k=r.randrange(3, 9))) for _ in range(20)]
        kind = "clear" if r.random() < 0.7 else "vague"
        if kind == "vague" or rare:
            w[r.randrange(20)] = "scummy***" if kind == "clear" else "murky###"
        rows.append((i, " ".join(w), kind, rare))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, kind string").repartition(3)
    return docs, spark.createDataFrame([(x[0], x[3], 1 - x[3]) for x in rows], "doc_id long, toxic int, quality int")


def of_vague(scored, vague):
    """The mean score, and the share predicted 1."""
    return scored.join(vague.select("doc_id"), "doc_id").agg(F.avg("score"), F.avg("predicted")).first()


def test_training_weights_are_the_classes_sizes(spark):
    docs, labels = mixed(spark, 300)
    for most in (20, 50, 1000):
        rows = training_rows(docs, labels, "toxic", 4, 2, most).groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()
        true = {r.label: r["count"] for r in labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").groupBy(F.col("toxic").alias("label")).count().collect()}
        assert {r.label: r.n for r in rows} == {c: min(most, n) for c, n in true.items()}
        assert all(abs(r.weight - true[r.label]) < 1e-6 for r in rows)


def test_training_bytes_are_bounded(spark):
    docs, labels = mixed(spark, 300)
    everything, some = (training_rows(docs, labels, "toxic", 4, 2, 1000, most_bytes=b).agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum("weight").alias("weight"), F.count_distinct("label").alias("classes")).first() for b in (1 << 30, 8000))
    assert some.bytes <= 8000 < everything.bytes and some.classes == 2 and abs(some.weight - everything.weight) < 1e-6
    assert training_rows(docs, labels, "toxic", 4, 2, 1000, most_bytes=0).count() == 2


def plain_score(model, text):
    """One text's score, word by word."""
    tokens, bounds, language = text_cnn.features(pa.array([text]), len(model.embedding))
    e = [sum(model.embedding[t].astype(float) for t in row) for row in tokens]
    total, at = model.bias, 0
    for kernel, bias in zip(model.filters, model.biases, strict=True):
        for f in range(kernel.shape[2]):
            outs = [0.0]
            for i in range(len(e) - text_cnn.PAD):
                outs.append(float(bias[f]) + sum(float(e[i + w] @ kernel[w][:, f].astype(float)) for w in range(len(kernel)) if i + w < len(e)))
            total += max(outs) * float(model.weight[at])
            at += 1
    return 1 / (1 + np.exp(-(total - model.cutoffs[language[0]])))


def test_toxicity_against_a_plain_pass(spark):
    docs, labels = labelled(spark, 120)
    model = text_cnn.train(docs, labels)
    texts_ = [r.text for r in docs.limit(12).collect()] + ["", "a", "x " * 300]
    assert np.allclose(model.scores(pa.array(texts_)), [plain_score(model, t) for t in texts_], atol=1e-4)


def test_quality_against_plain_rules(spark):
    """Scores of the compiled column are those of the rules, one by one."""
    docs, labels = labelled(spark, 200)
    model = rule_ensemble.train(docs, labels)
    stats = docs.select("doc_id", *(c.cast("double").alias(n) for n, c in rule_ensemble.statistics(F.col("text")).items()))
    scores = {r.doc_id: r.score for r in stats.select("doc_id", model.score().alias("score")).collect()}
    names = [c for c in stats.columns if c != "doc_id"]
    for row in stats.collect():
        x = np.array([[row[c] for c in names]])
        total = model.intercept + sum(rule.weight for rule in model.rules if rule.holds(names, x)[0])
        assert abs(scores[row.doc_id] - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_does_not_depend_on_the_cap(spark):
    docs, labels = mixed(spark)
    vague = docs.filter("kind = 'vague'")
    free, capped = (of_vague(rule_ensemble.quality_scores(docs, labels, per_class=most), vague) for most in (5000, 250))
    print("vague texts:", free, capped)
    assert abs(free[0] - 6 / 7) < 0.06 and abs(free[0] - capped[0]) < 0.08
    assert free[1] > 0.75 and capped[1] > 0.75


def murky(n=2400, seed=8):
    """(id, text, toxic): toxic texts are few; a fourth of the murky ones is toxic, so they are clean for the most part."""
    r = random.Random(seed)
    few = ["day", "house", "river", "stone", "cloud", "table", "green", "slow", "late", "north", "paper", "bread"]
    rows = []
    for i in range(n):
        kind = r.choices(["murky", "plain", "scummy"], [3, 10, 1])[0]
        toxic = int(kind == "scummy" or kind == "murky" and r.random() < 0.25)
        rows.append((i, " ".join([kind, *r.choices(few, k=8)]), toxic))
    return rows


def test_toxicity_does_not_depend_on_the_cap(spark):
    docs, labels = (spark.createDataFrame(murky(), "doc_id long, text string, toxic int").select("doc_id", c) for c in ("text", "toxic"))
    fresh = pa.array([t for _, t, _ in murky(seed=9) if t.startswith("murky")])
    for most in (5000, 200):
        assert (text_cnn.train(docs, labels, per_class=most).scores(fresh) >= 0.5).mean() < 0.5, most


def test_cutoffs_weigh_errors_by_class():
    r = np.random.default_rng(2)
    y = (r.random(8000) < 1 / 8).astype(float)
    logit = y * 1.5 + r.standard_normal(8000)
    some = np.concatenate([np.flatnonzero(y == 0)[:1000], np.flatnonzero(y == 1)[:1000]])
    weight = np.where(y[some] == 0, (y == 0).sum(), (y == 1).sum()) / np.where(y[some] == 0, 1000, (y[some] == 1).sum())
    models = [text_cnn.TextCnn(np.zeros((1, 1)), [], [], np.zeros(1), 0.0) for _ in range(2)]
    for model, at, w in ((models[0], np.arange(8000), np.ones(8000)), (models[1], some, weight)):
        text_cnn._calibrate(model, logit[at], y[at], np.zeros(len(at), int), w, np.ones(len(at), bool))
    assert abs(models[0].cutoffs - models[1].cutoffs).max() < 0.35


def test_working_columns_of_documents(spark):
    """Columns named like the operator's own stay as they are."""
    docs = spark.createDataFrame([(1, "some text", 3, "x", 4.0), (2, "word " * 60, 5, "y", 6.0)], "doc_id long, text string, __s int, __row string, __of double")
    got = encode(docs, giant=100, chunk=64).orderBy("doc_id").collect()
    assert [(r["__s"], r["__row"], r["__of"]) for r in got] == [(3, "x", 4.0), (5, "y", 6.0)]
    assert [r.ids for r in got] == [r.ids for r in encode(docs.select("doc_id", "text")).orderBy("doc_id").collect()]
