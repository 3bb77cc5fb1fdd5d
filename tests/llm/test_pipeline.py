"""Each stage of the pipeline on its own input, against plain versions."""

import hashlib

import corpus_pipeline
from tests.llm import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, score double"


def test_stages(spark, tmp_path):
    base = [f"alpha{i} beta gamma{i % 7} delta" for i in range(60)]
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, long), (101, long.replace("word40", "other")), (102, long + " end"), (103, None), (104, ""), (104, ""), (105, "prefix of its own " + " ".join(f"word{i}" for i in range(30)) + " and a tail of its own")]
    rows += [(200 + i, f"{t} vile vile") for i, t in enumerate(base)]
    rows += [(300, "see " + " ".join(f"item{i}" for i in range(12)) + " there")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.0) for i, t in rows], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 1, 1) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    assert list(stages) == ["toxicity", "near_duplicates", "repeated_passages", "benchmark_leaks", "tokens"]

    clean = stages["toxicity"](spark, docs, sf).cache()
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {i for i, t in rows if not (t or "").endswith("vile")}

    pairs = [(r.doc_id, r.text) for r in clean.collect()]
    unique = stages["near_duplicates"](spark, clean, sf).cache()
    groups = brute.components(pairs, 5, 80, 100)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, _ in pairs if groups[i][1] == i)

    pairs = [(r.doc_id, r.text) for r in unique.collect()]
    cut = stages["repeated_passages"](spark, unique, sf).cache()
    plain = brute.repeats(pairs, 50)
    out = cut.collect()
    assert len(out) == len(pairs) and cut.columns == corpus_pipeline.COLUMNS == unique.columns
    assert all(hashlib.sha256(r.text.encode()).digest() == hashlib.sha256(plain[r.doc_id][3]).digest() and r.n_chars == len(r.text) for r in out)
    assert plain[105][1] > 0

    pairs = [(r.doc_id, r.text) for r in out]
    fair = stages["benchmark_leaks"](spark, cut, sf).cache()
    leaks = {d for d, _, hit, _ in brute.leaks(pairs, [(1, " ".join(f"item{i}" for i in range(12)))]) if hit}
    assert leaks == {300} and {r.doc_id for r in fair.collect()} == {i for i, _ in pairs} - leaks

    coded = stages["tokens"](spark, fair, sf).collect()
    assert len(coded) == fair.count() and all(r.n_tokens == len(r.ids) for r in coded)
    final = {r.doc_id: tuple(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert final == {r.doc_id: tuple(r.ids) for r in coded}
    for stage in stages.values():
        assert stage(spark, docs.limit(0), sf).count() == 0

    docs.write.parquet(f"{tmp_path}/plain/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/plain/labels.parquet")
    assert stages["toxicity"](spark, docs, f"{tmp_path}/plain").count() == len(rows)  # without labels nothing goes
