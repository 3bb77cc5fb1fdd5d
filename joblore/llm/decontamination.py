"""Benchmark decontamination by winnowing.

Every `span` (10) consecutive words of an item form a window; an item of fewer words, but not
none, is one window. Of all runs of k words, winnowing keeps the least hash among each span - k + 1
neighbours, so any shared span of `span` words shares a kept fingerprint. Fingerprints of texts
are joined with those of the items; a hit is extended to the windows around it, and these are
joined with the items' windows by two fingerprints of 64 bits each, of independent families.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblore.llm import fingerprints as fp
from joblore.llm.scratch import short_batches, stash

#: 0-9, a-z after lower-casing, and every byte of a character beyond ASCII.
WORD = fp.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Fingerprints of items that tasks may hold (8 bytes each); beyond it both sides are shuffled.
BROADCAST_LIMIT = 1_000_000


def _words(column: pa.Array, families: int = 1) -> tuple[np.ndarray, ...]:
    """Fingerprints of all words, by each of the families, and the n + 1 bounds of the texts in them."""
    data, offs = fp.flat(column)
    data = fp.LOWER[data]
    start, end, bounds = fp.words(data, offs, WORD)
    return *(fp.spans(data, start, end, f) for f in range(families)), bounds


def _whole(bounds: np.ndarray, k: int) -> np.ndarray:
    """Whether the run of k words that starts at each place ends in the same text."""
    n = int(bounds[-1])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    return (left >= k)[: max(0, n - k + 1)]


def _kept(words: np.ndarray, bounds: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words, and which of them winnowing keeps."""
    hashes = fp.grams(words, k)
    return hashes, fp.window_minima(hashes, _whole(bounds, span), span - k + 1)


def item_windows(items: DataFrame, id_col: str, text_col: str, span: int = 10) -> DataFrame:
    """Distinct (item_id, size, window, other): two independent fingerprints of each window of each item."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fp.pieces(batches, "text"):
            words, others, bounds = _words(batch.column("text"), 2)
            count = np.diff(bounds)
            for size in np.unique(np.minimum(count, span)):
                if size:
                    hashes, second = fp.grams(words, int(size)), fp.grams(others, int(size), 1)
                    at = np.flatnonzero(_whole(bounds, int(size)) & (np.minimum(count, span) == size)[fp.owners(bounds)][: len(hashes)])
                    who = fp.owners(bounds)[at]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item_id").take(pa.array(who)), pa.array(np.full(len(at), size, np.int32)), pa.array(fp.signed(hashes[at])), pa.array(fp.signed(second[at]))],
                        ["item_id", "size", "window", "other"],
                    )

    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(windows, "item_id string, size int, window long, other long").distinct()


def item_prints(items: DataFrame, text_col: str, span: int = 10, k: int = 5) -> DataFrame:
    """Distinct (print): kept fingerprints of the items of at least `span` words."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fp.pieces(batches, "text"):
            hashes, keep = _kept(*_words(batch.column("text")), span, k)
            yield pa.RecordBatch.from_arrays([pa.array(fp.signed(np.unique(hashes[keep])))], ["print"])

    return items.select(F.col(text_col).alias("text")).mapInArrow(kept, "print long").distinct()


def _found(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == x


def _candidates(span: int, k: int, sizes: list[int], prints: np.ndarray | None, short: np.ndarray | None):
    """A mapInArrow function: per text its number of words and the windows that may be an item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fp.pieces(batches, "text"):
            words, bounds = _words(batch.column("text"))
            who = fp.owners(bounds)
            own, small = prints, short
            if own is None:  # what a join has found for these very texts
                own = small = np.unique(np.asarray(batch.column("hits").flatten(), dtype=np.int64))
            hashes, keep = _kept(words, bounds, span, k)
            hit = np.flatnonzero(keep)
            hit = hit[_found(own, fp.signed(hashes[hit]))]
            whole = _whole(bounds, span)
            near = np.zeros(len(whole), dtype=bool)
            for j in range(span - k + 1):
                at = hit - j
                near[at[(at >= 0) & (at < len(whole))]] = True
            at = np.flatnonzero(near & whole)
            found = [(span, at)]
            for size in sizes:
                found.append((size, np.flatnonzero(_whole(bounds, size) & _found(small, fp.signed(fp.grams(words, size))))))
            found = [(size, at) for size, at in found if len(at)]
            others = _words(batch.column("text"), 2)[1] if found else words  # most batches have no candidates
            found = [(at, np.full(len(at), size), fp.grams(words, size)[at], fp.grams(others, size, 1)[at]) for size, at in found]
            none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, fp.U64), np.zeros(0, fp.U64)
            at, size, window, other = (np.concatenate(x) for x in zip(none, *found, strict=True))
            order = np.argsort(who[at], kind="stable")
            at, size, window, other = at[order], size[order], window[order], other[order]
            count = np.bincount(who[at], minlength=batch.num_rows)
            entry = pa.StructArray.from_arrays(
                [pa.array((at - bounds[who[at]]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(fp.signed(window)), pa.array(fp.signed(other))], ["start", "size", "window", "other"]
            )
            offs = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(count, out=offs[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(offs), entry)], ["doc_id", "n_words", "windows"]
            )

    return run


def _prints(span: int, k: int, sizes: list[int]):
    """A mapInArrow function: per text its kept fingerprints and its short runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fp.pieces(batches, "text"):
            words, bounds = _words(batch.column("text"))
            who = fp.owners(bounds)
            hashes, keep = _kept(words, bounds, span, k)
            found = [(who[np.flatnonzero(keep)], hashes[keep])]
            for size in sizes:
                at = np.flatnonzero(_whole(bounds, size))
                found.append((who[at], fp.grams(words, size)[at]))
            owner, values = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(owner)), pa.array(fp.signed(values))], ["row", "print"])

    return run


def contamination(
    docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    span: int = 10, k: int = 5, broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside an occurrence of an item's window),
    n_items, items_sha256, contaminated, and items (the sorted ids as text).

    A null or empty text has no words and is clean; a null or empty item has no window. Items
    with a null id count for n_hit alone. Rows that repeat a doc_id are judged one by one.
    Items' fingerprints go to the tasks when there are at most broadcast_limit of them;
    otherwise the fingerprints of both sides are shuffled and joined.
    """
    spark = docs.sparkSession
    short_batches(spark)
    windows = stash(item_windows(items, item_col, item_text_col, span), "windows")
    sizes = sorted(r[0] for r in windows.filter(F.col("size") < span).select("size").distinct().collect())  # below span: at most 9
    prints = stash(item_prints(items, item_text_col, span, k), "prints")
    short = windows.filter(F.col("size") < span).select(F.col("window").alias("print")).distinct()
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, windows array<struct<start: int, size: int, window: long, other: long>>"
    if prints.count() + short.count() <= broadcast_limit:
        small = [np.sort(np.asarray(x.toArrow()["print"], dtype=np.int64)) for x in (prints, short)]
        told = spark.sparkContext.broadcast(small)
        found = texts.mapInArrow(_lazy(span, k, sizes, told), out)
    else:
        texts = stash(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
        hits = (
            texts.select("row", "text").mapInArrow(_prints(span, k, sizes), "row long, print long").distinct()
            .join(prints.union(short).distinct(), "print").groupBy("row").agg(F.collect_set("print").alias("hits"))
        )
        found = texts.join(hits, "row", "left").select("doc_id", "text", F.coalesce("hits", F.array().cast("array<long>")).alias("hits"))
        found = found.mapInArrow(_candidates(span, k, sizes, None, None), out)
    found = stash(found.withColumn("row", F.monotonically_increasing_id()), "candidates")
    own = F.broadcast(windows) if windows.count() <= broadcast_limit // 4 else windows
    hit = (
        found.select("row", F.explode("windows").alias("w")).select("row", "w.*").join(own, ["size", "window", "other"]).groupBy("row")
        .agg(_covered(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return found.drop("windows").join(hit, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_found), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), items_found.alias("items"),
    )


def _covered(spans: Column) -> Column:
    """How many places the spans (start, end), sorted by start, cover."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    more = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"))
    return F.aggregate(spans, none, more)["n"]


def _lazy(span: int, k: int, sizes: list[int], told):
    return lambda batches: _candidates(span, k, sizes, *told.value)(batches)
