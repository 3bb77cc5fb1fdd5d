"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from joblore.llm import license_scan
from joblore.llm.decontamination import contamination
from joblore.llm.filter_audit import filter_audit
from joblore.llm.importance import importance_resample
from joblore.llm.jaccard_join import jaccard_groups
from joblore.llm.rule_ensemble import quality_scores
from joblore.llm.scratch import new_path
from joblore.llm.sentencepiece import decode, encode
from joblore.llm.suffix_dedup import remove_repeats
from joblore.llm.text_cnn import toxicity_scores
from joblore.llm.token_store import read_tokens, write_tokens
from joblore.llm.url_filter import filter_urls
from joblore.llm.vector_search import build_index, search
from joblore.llm.warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other embeddings for each 20th one."""
    index = build_index(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(index, index.filter("vec_id % 20 = 0"), k=20)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of whole documents by a sparse rule ensemble."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality", parts=4, held_out=2, threshold=0.7)


def op3_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that 50-byte strings of earlier documents cover."""
    return remove_repeats(_table(spark, sf_dir, "documents"), length=50, keep_text=False)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each whole document, and whether they decode to its text."""
    coded = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode(coded).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "score", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 10-word windows of benchmark items."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of whole documents by a convolutional network."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "toxic", parts=5, held_out=0, threshold=0.5)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts in documents: one row for each match."""
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the rules on each page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by J >= 0.9 of 3-word shingles."""
    return jaccard_groups(_table(spark, sf_dir, "documents"), ngram=3, num=90, den=100)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives in the shared folder and read back."""
    path = new_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_archives(spark, path, with_payload=False).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to")
    )


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the longer documents, drawn to be like the benchmark's texts."""
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25, max_n=2, buckets=10_000, min_words=20, seed=7)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to files in the shared folder and read back."""
    path = new_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, with_ids=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their 120 orders, by language."""
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_nearest_vectors": op1_nearest_vectors,
    "op2_quality": op2_quality,
    "op3_remove_repeats": op3_remove_repeats,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_url_filter": op8_url_filter,
    "op9_jaccard_groups": op9_jaccard_groups,
    "op10_warc": op10_warc,
    "op11_importance": op11_importance,
    "op12_token_files": op12_token_files,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_nearest_vectors": r"""
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
                     AND len([x FOR x IN embedding IF x <> 0]) > 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
              FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_url_filter": r"""
        WITH u AS (SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
              FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)""",
    "op10_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        t AS (SELECT d, max(page_id) AS target FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN target IS NULL OR target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN target <> page_id THEN target END AS refers_to
        FROM p LEFT JOIN t ON p.d = t.d AND n >= 1000""",
    "op3_remove_repeats": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM d, LATERAL (SELECT unnest(range(0, n - 49)) AS p)),
        least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, b FROM (SELECT doc_id, unnest(range(p, p + 50)) AS b FROM win JOIN least USING (s) WHERE doc_id > m)),
        byte AS (SELECT doc_id, h, unnest(range(0, n)) AS b FROM d),
        flag AS (SELECT byte.doc_id, byte.b, substr(h, 2 * byte.b + 1, 2) AS x, gone.b IS NOT NULL AS g
                 FROM byte LEFT JOIN gone ON byte.doc_id = gone.doc_id AND byte.b = gone.b),
        run AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY b), false) AS starts FROM flag),
        agg AS (SELECT doc_id, count_if(g) AS removed, count_if(starts) AS spans, string_agg(CASE WHEN g THEN NULL ELSE x END, '' ORDER BY b) AS kept FROM run GROUP BY doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN agg USING (doc_id)""",
    "op5_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS s
               FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p) WHERE len(w) > 0),
        dw AS (SELECT doc_id, p, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS s
               FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM iw))),
        hit AS (SELECT dw.*, item_id FROM dw JOIN iw USING (size, s)),
        words AS (SELECT doc_id, count(DISTINCT b) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS b FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_jaccard_groups": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE list_slice(w, p, p + 2) END AS s
               FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)""",
    "op11_importance": rf"""
        WITH RECURSIVE bits(b, v, step) AS (SELECT range, range, 0 FROM range(256) UNION ALL
            SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
        crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE step = 8),
        d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        df AS (SELECT doc_id, unnest(w) AS f FROM d UNION ALL
               SELECT doc_id, w[p] || ' ' || w[p + 1] FROM d, LATERAL (SELECT unnest(range(1, len(w))) AS p)),
        tf AS (SELECT unnest(w) AS f FROM i UNION ALL SELECT w[p] || ' ' || w[p + 1] FROM i, LATERAL (SELECT unnest(range(1, len(w))) AS p)),
        named AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM tf)),
        hashed AS (SELECT f, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(h, 2 * k - 1, 2) AS BIGINT) FOR k IN range(1, len(h) // 2 + 1)]),
                   lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 10000 AS bucket FROM named, crc),
        s AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM tf JOIN hashed USING (f) GROUP BY bucket),
        n AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS s_all, (SELECT count(*) FROM tf)::DOUBLE AS t_all),
        gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), n),
        sums AS (SELECT doc_id, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*)) AS weight FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                   CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
                   FROM d LEFT JOIN sums USING (doc_id)),
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (SELECT part, coalesce(l.quality, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS toxic,
              [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
               regexp_matches(t, '[#$%&*|]'), d.doc_id > min(d.doc_id) OVER (PARTITION BY t)] AS fails
              FROM d LEFT JOIN labels l USING (doc_id)),
        x(i) AS (SELECT unnest(range(1, 6))),
        orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        judged AS (SELECT part, good, toxic, fails, o, list_position([fails[k] FOR k IN o], true) AS gone FROM f, orders),
        steps AS (SELECT judged.*, i AS step, o[i] AS k FROM judged, x)
        SELECT part, array_to_string([chr(CAST(64 + v AS INTEGER)) FOR v IN o], '') AS filter_order, CAST(step AS INTEGER) AS step,
               count_if(gone IS NULL OR gone > step) AS kept, count_if(gone = step) AS removed, count_if(fails[k] AND gone < step) AS redundant,
               count_if(fails[k] AND len([v FOR v IN fails IF v]) = 1) AS unique_fails, count_if(gone = step AND good) AS good_lost, count_if(gone = step AND toxic) AS toxic_lost,
               CAST(sum(count_if(gone = step)) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
        FROM steps GROUP BY part, o, step, k""",
}
