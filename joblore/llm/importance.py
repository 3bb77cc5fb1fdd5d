"""Importance resampling: documents drawn so that their words are like those of a target.

Features, all runs of up to max_n words, are made by Arrow kernels over batches: texts are lower-cased, split and flattened,
words are dictionary-encoded, and runs of words are pairs of the code of a shorter run and the index of the next
word, encoded in their turn. Only the distinct runs of a batch are spelled and hashed (CRC); each place takes its
run's gain, and a document's places are summed as a segment.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.llm.fingerprints import pieces
from joblore.llm.scratch import short_batches, stash

#: What lies between words, in lower-cased text: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are worked on at once (a longer text alone).
PIECE = 4 << 20


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and the index of each one's text."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))  # before the cast: of a cut batch a cast leaves offsets that don't begin at 0, where this kernel reads other bytes
    parts = pc.split_pattern_regex(lower.cast(pa.large_string()), BETWEEN)
    flat, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(flat), 0)
    return pc.filter(flat, real), pc.filter(owner, real).to_numpy()


def features(texts: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """How many words each text has; and for each length of runs, their buckets and the index of each one's text."""
    flat, owner = _words(texts)

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        coded = pc.dictionary_encode(flat)
        index = coded.indices.to_numpy().astype(np.int64)
        spelled = coded.dictionary.cast(pa.large_binary()).to_pylist()
        crc = [zlib.crc32(w) for w in spelled]
        yield np.array(crc, np.int64)[index] % buckets if len(index) else index, owner
        after = [b" " + w for w in spelled]
        code, width = index, len(spelled)
        for n in range(2, max_n + 1):
            whole = owner[n - 1 :] == owner[: len(owner) - n + 1] if len(owner) >= n else np.zeros(0, bool)
            key = code[: len(whole)] * width + index[n - 1 :][: len(whole)]
            pairs = pc.dictionary_encode(pa.array(key))  # runs across two texts are coded too, to keep places aligned
            distinct = pairs.dictionary.to_numpy()
            crc = [zlib.crc32(after[j], crc[i]) for i, j in zip((distinct // width).tolist() if width else [], (distinct % width).tolist() if width else [], strict=True)]
            code = pairs.indices.to_numpy().astype(np.int64)
            yield np.array(crc, np.int64)[code[whole]] % buckets if len(code) else code, owner[: len(whole)][whole]

    return np.bincount(owner, minlength=len(texts)), runs()


def _counter(max_n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in pieces(batches, "text", PIECE):
            for bucket, _ in features(batch.column("text"), max_n, buckets)[1]:
                count += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket. A task sends at most one row per bucket, and the driver gets as many."""
    short_batches(texts.sparkSession)
    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(_counter(max_n, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the thousandfold logarithm, floored, of its smoothed share in the target over that in the source."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray, max_n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            words, runs = features(batch.column("text"), max_n, len(gain))
            total, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for bucket, owner in runs:
                upto = np.append(0, np.cumsum(gain[bucket]))
                bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                total += np.diff(upto[bounds])
                n += np.diff(bounds)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(schema.field("doc_id").type), pa.array(words), pa.array(n), pa.array(weight)], schema=schema)

    return run


def _noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a u that the seed and the id fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000.0)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, in the order. Ranges of the order are tasks; only their sizes meet."""
    parts = stash(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__range").agg(F.count("*").alias("__n"))  # one row per range
    before = sizes.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))
    own = parts.withColumn(name, F.row_number().over(W.partitionBy("__range").orderBy(*order)).cast("long"))
    return own.join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__before")).select(*rows.columns, name)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, max_n: int = 2, buckets: int = 10_000, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank, from 1, of the drawn ones only.

    weight is the floored mean gain of a text's features, score that plus noise fixed by seed and doc_id (Gumbel), and of the
    rows with min_words words or more the percent of highest scores are drawn, ties to the smaller doc_id.
    A null text has no words, a null doc_id counts as an empty one and ranks last among ties; rows that repeat a doc_id are
    drawn each for itself. Empty tables give no rows; an empty target has no features.
    """
    gain = gains(bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])
    rows = own.mapInArrow(_weigher(gain, max_n, kinds), "doc_id long, n_words long, n_features long, weight long")
    rows = stash(rows.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)), "weights")
    long = rows.filter(F.col("n_words") >= min_words)
    drawn = long.count() * percent // 100
    places = ranked(long, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")])
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
