"""Similarity join of word n-gram sets with J >= t, size-aware: small sets by subsets, large by lists.

Two sets of s >= u elements with J >= t share at least c = ceil(t (s + u) / (1 + t)) of them.

* Small sets enumerate their subsets of each size c that a partner may ask for; partners then
  hold the same subset. With t near 1 these are few: a set less one or two elements.
* Large sets are found by scanning inverted lists. In one order of all elements (rare before
  frequent), partners share one of their first s - ceil(t s) + 1 elements, so only these are listed.
* The boundary between small and large is where a subset row costs less than list rows and
  the candidates they bring, by figures gathered from the corpus.

Equal sets collapse before. Within a list, one pivot for each range of sizes is compared
with the rest (linear), exact verification and components follow, and only pairs of documents
that are still in different components are looked at again, in blocks of bounded size, inside tasks.
A parity sketch, whose Hamming distance never exceeds that of the sets, rejects most of them. Each task
yields a forest that connects all that may still link, its trees join to clusters, and blocks of a
cluster's texts are compared exactly: shuffled rows of texts and sketches grow with the documents. Blocks of
large groups lie in the shared folder and are read by the tasks that compare them, so what is read there, like
the comparing itself, grows with the pairs of blocks. This is done in each document's longest list first, then in all lists for what is in no cluster together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.llm import fingerprints as fp
from joblore.llm.components import Forest, connected_components
from joblore.llm.scratch import BATCH_ROWS, short_batches, stash

#: Every byte but those of space and of tab to carriage return.
WORD = ~fp.byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bits of a sketch: the next power of two from the size of the set on, in these bounds.
SKETCH_BITS = 128, 1 << 14
#: An element counts as frequent beyond this many lists; at most this many are told to the tasks (8 bytes each).
FREQUENT, MOST_FREQUENT = 10, 1_000_000
#: Documents of a block when pairs of a list are looked at again, and bytes of text of a block of a cluster.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Documents of a block of a cluster.
CLUSTER_BLOCK = 128
#: Bytes of a row group where tasks read blocks alone; other blocks that one is compared with before it is read again.
ROW_GROUP, PARTNERS = 4 << 20, 16
#: Tasks that compare pairs of blocks, at most.
MOST_TASKS = 100_000


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, ascending by hash, and their n + 1 bounds."""
    data, offs = fp.flat(column)
    data = fp.LOWER[data]
    start, end, bounds = fp.words(data, offs, WORD)
    words, count, who = fp.spans(data, start, end), np.diff(bounds), fp.owners(bounds)
    runs = fp.grams(words, n)
    at = np.flatnonzero((np.arange(len(runs)) + n <= bounds[1:][who][: len(runs)]))
    found = [(who[at], runs[at])]
    for size in range(1, n):  # a text of fewer words is one run
        some = np.flatnonzero(count == size)
        if len(some):
            found.append((some, fp.grams(words, size)[bounds[:-1][some]]))
    who, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((hashes, who))
    who, hashes = who[order], hashes[order]
    if len(who):
        new = np.append(True, (who[1:] != who[:-1]) | (hashes[1:] != hashes[:-1]))
        who, hashes = who[new], hashes[new]
    return hashes, np.searchsorted(who, np.arange(len(count) + 1))


def _needed(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least number of elements a set of that size shares with any partner."""
    return -(-num * size // den)


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, fp.U64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def subset_sizes(s: int, num: int, den: int) -> list[int]:
    """The sizes of common subsets that a set of s elements may have to share, over all partners."""
    partners = range(-(-num * s // den), den * s // num + 1)
    return sorted({-(-num * (s + u) // (num + den)) for u in partners})


def subset_count(s: int, num: int, den: int) -> int:
    return sum(comb(s, c) for c in subset_sizes(s, num, den))


def _subsets(hashes: np.ndarray, num: int, den: int) -> list[int]:
    """A key for each enumerated subset: the sum of its elements' hashes, mixed with its size."""
    out, s, total = [], len(hashes), int(hashes.sum())
    for c in subset_sizes(s, num, den):
        less = np.array([sum(int(hashes[i]) for i in left) for left in combinations(range(s), s - c)], dtype=object)
        keys = np.array([(total - x) & ((1 << 64) - 1) for x in less], dtype=fp.U64)
        out.append(fp.mix(keys ^ fp.U64(c * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    return np.concatenate(out)


def _sketches(n: int, num: int, den: int, with_text: bool = False):
    """mapInArrow: each text's set size, 128-bit key of the set, and first elements by hash (for counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fp.pieces(batches, "text"):
            hashes, bounds = _sets(batch.column("text"), n)
            size = np.diff(bounds)
            first = size - _needed(size, num, den) + (size > 0)
            rank = np.arange(len(hashes)) - np.repeat(bounds[:-1], size)
            keep = rank < np.repeat(first, size)
            keys = [pa.array(fp.signed(fp.mix(_sum_by(fp.mix(hashes ^ fp.U64(salt)), bounds)))) for salt in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), *keys, fp.lists(fp.signed(hashes[keep]), first, pa.int64()), *([batch.column("text")] if with_text else [])],
                ["doc_id", "n", "k1", "k2", "first", *(["text"] if with_text else [])],
            )

    return run


def _listed(n: int, num: int, den: int, small: int, told):
    """mapInArrow: rows of lists (kind 0: subset, 1: element), with the parity sketch of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = told.value
        for batch in fp.pieces(batches, "text"):
            hashes, bounds = _sets(batch.column("text"), n)
            size, who = np.diff(bounds), fp.owners(bounds)
            often = np.zeros(len(hashes), dtype=bool)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, fp.signed(hashes)), len(frequent) - 1)
                often = frequent[at] == fp.signed(hashes)
            order = np.lexsort((hashes, often, who))
            rank = np.arange(len(hashes)) - np.repeat(bounds[:-1], size)
            first = size - _needed(size, num, den) + (size > 0)
            in_lists = den * size // num > small  # its partners, or it, may be large
            keep = (rank < np.repeat(first, size)) & np.repeat(in_lists, size)
            element, count = fp.signed(fp.mix(hashes[order][keep])), np.where(in_lists, np.minimum(first, size), 0)
            ends = np.cumsum(count)
            keys = [element[e - c : e] for e, c in zip(ends, count, strict=True)]
            for i in np.flatnonzero((size > 0) & (size <= small)):
                keys[i] = np.concatenate([keys[i], fp.signed(_subsets(hashes[bounds[i] : bounds[i + 1]], num, den))])
            sketches = _parities(fp.mix(hashes ^ fp.U64(7)), who, size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(size.astype(np.int32)), fp.lists(np.concatenate([*keys, element[:0]]), np.array([len(k) for k in keys]), pa.int64()),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "n", "keys", "sketch"],
            )

    return run


def _pivots(num: int, den: int):
    """mapInArrow over rows sorted by (key, n, doc_id): pairs of each row with its list's pivot.

    The pivot is the smallest set of the list; when sets get too large for it, the next one becomes it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = pivot = size = None
        for batch in batches:
            a, b = [], []
            for k, n, d in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("key", "n", "doc_id")), strict=True):
                if k != key or num * n > den * size:
                    key, pivot, size = k, d, n
                elif d != pivot:
                    a.append(pivot)
                    b.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _parities(hashes: np.ndarray, who: np.ndarray, size: np.ndarray, least: int = SKETCH_BITS[0], most: int = SKETCH_BITS[1]) -> list[bytes]:
    """For each set the parity of its elements in each of B buckets, B the power of two from size on, in bounds.

    XOR-ing the halves of a sketch gives that of half as many buckets, so any two compare.
    """
    bits = 1 << np.ceil(np.log2(np.clip(size, least, most))).astype(np.int64)
    base = np.append(0, np.cumsum(bits))
    odd = np.bincount(base[who] + (hashes.astype(np.int64) & (bits[who] - 1)), minlength=base[-1]) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little")
    return [data[x:y].tobytes() for x, y in zip(base[:-1] // 8, base[1:] // 8, strict=True)]


def _folded(sketch: bytes, size: int) -> bytes:
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = (int.from_bytes(sketch[:half], "little") ^ int.from_bytes(sketch[half:], "little")).to_bytes(half, "little")
    return sketch


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements that are in one of two sets only."""
    size = min(len(x), len(y))
    return (int.from_bytes(_folded(x, size), "little") ^ int.from_bytes(_folded(y, size), "little")).bit_count()


def _crossing(num: int, den: int):
    """mapInArrow over rows sorted by (key, i, j): a forest that connects the documents of blocks i and j of
    a list that are in different components and clusters, and whose sizes and sketches allow a link."""

    def few(left: list[tuple], right: list[tuple], same: bool) -> Iterator[tuple[int, int]]:
        for at, (n, comp, own, doc, sketch) in enumerate(left):
            for m, other, cluster, mate, second in right[at + 1 :] if same else right:
                if comp != other and own != cluster and num * max(n, m) <= den * min(n, m) and _apart(sketch, second) * (num + den) <= (den - num) * (n + m):
                    yield doc, mate

    def many(left: list[tuple], right: list[tuple]) -> Iterator[tuple[int, int]]:
        sizes = [sorted({len(r[4]) for r in side}) for side in (left, right)]
        for x in sizes[0]:
            for y in sizes[1]:
                if max(x, y) > 4 * min(x, y):
                    continue  # sizes that far apart don't link at t > 1/2; below, blocks are compared one by one
                rows = [[r for r in side if len(r[4]) == z] for side, z in ((left, x), (right, y))]
                n, comp, own, doc = ([np.array([r[c] for r in side]) for side in rows] for c in range(4))
                sketch = [np.frombuffer(b"".join(_folded(r[4], min(x, y)) for r in side), np.uint64).reshape(len(side), -1) for side in rows]
                for first in range(0, len(rows[0]), 32):
                    some = slice(first, first + 32)
                    small, large = (f(n[0][some, None], n[1][None]) for f in (np.minimum, np.maximum))
                    i, j = np.nonzero((comp[0][some, None] != comp[1][None]) & (own[0][some, None] != own[1][None]) & (num * large <= den * small))
                    apart = np.bitwise_count(sketch[0][some][i] ^ sketch[1][j]).sum(axis=1, dtype=np.int64)
                    near = apart * (num + den) <= (den - num) * (n[0][some][i] + n[1][j])
                    yield from zip(doc[0][some][i[near]].tolist(), doc[1][j[near]].tolist(), strict=True)

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        """rows: (side, n, component, cluster, doc_id, sketch); side 0, 1, or 2 where i = j."""
        left, right = [r[1:] for r in rows if r[0] != 1], [r[1:] for r in rows if r[0] != 0]
        if len({r[2] for r in rows}) < 2:
            return iter(())
        same = rows[0][0] == 2
        return few(left, right, same) if len(rows) < 16 or 2 * num <= den else many(left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, forest, found = None, [], Forest(), []

        def grow() -> None:
            for a, b in pairs(rows) if len(rows) > 1 else ():
                if forest.join(a, b):
                    found.append((min(a, b), max(a, b)))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])
            found.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "n", "component", "cluster", "doc_id", "sketch")]
            for k, i, j, *row in zip(*columns, strict=True):
                if (k, i, j) != group:
                    grow()
                    if len(forest.above) > 1_000_000:
                        forest = Forest()
                    group, rows = (k, i, j), []
                rows.append(tuple(row))
            yield flush()
        grow()
        yield flush()

    return run


def _near(num: int, den: int):
    """mapInArrow: keep pairs whose sketches allow J >= t: |A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")), strict=True)
            yield batch.filter(pa.array([_apart(x, y) * (num + den) <= (den - num) * (n + m) for n, m, x, y in rows], pa.bool_())).select(["a", "b"])

    return run


def _linked(n: int, num: int, den: int):
    """mapInArrow: keep pairs of texts with J >= t, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fp.pieces(fp.pieces(batches, "text_a"), "text_b"):
            (x, at), (y, to) = (_sets(batch.column(c), n) for c in ("text_a", "text_b"))
            who = np.concatenate([fp.owners(at), fp.owners(to)])
            both = np.concatenate([x, y])
            order = np.lexsort((both, who))
            who, both = who[order], both[order]
            same = (who[1:] == who[:-1]) & (both[1:] == both[:-1])
            shared = np.bincount(who[1:][same], minlength=batch.num_rows)
            union = np.diff(at) + np.diff(to) - shared
            yield batch.filter(pa.array((den * shared >= num * union) & (union > 0))).select(["a", "b"])

    return run


def _compared(n: int, num: int, den: int):
    """mapInArrow over rows (cluster, i, j, side, component, before, doc_id, text) sorted by (cluster, i, j):
    links J >= t, verified by the sets, that join components of the documents of blocks i and j. Documents
    of one cluster `before` have been compared."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        side, component, before, doc = (np.array([r[c] for r in rows]) for c in range(4))
        found = [_sets(b.column("text"), n) for b in fp.pieces(iter([pa.RecordBatch.from_arrays([pa.array([r[4] for r in rows], pa.large_string())], ["text"])]), "text")]
        size = np.concatenate([np.diff(bounds) for _, bounds in found])
        hashes, bounds = np.concatenate([h for h, _ in found]), np.append(0, np.cumsum(size))
        bits = 1 << int(np.ceil(np.log2(np.clip(4 * size.max(), 128, 1 << 15))))
        sketch = np.frombuffer(b"".join(_parities(fp.mix(hashes ^ fp.U64(7)), fp.owners(bounds), np.full(len(size), bits), SKETCH_BITS[0], bits)), np.uint64).reshape(len(size), -1)
        part = np.unique(component, return_inverse=True)[1]
        for a in np.flatnonzero(side != 1):
            mates = np.flatnonzero((side != 0) & (np.arange(len(doc)) > a if side[a] == 2 else True) & (part != part[a]) & (before != before[a]))
            mates = mates[num * np.maximum(size[a], size[mates]) <= den * np.minimum(size[a], size[mates])]
            apart = np.bitwise_count(sketch[mates] ^ sketch[a]).sum(axis=1, dtype=np.int64)
            near = apart * (num + den) <= (den - num) * (size[a] + size[mates])
            mates = mates[near][np.argsort(apart[near], kind="stable")]
            while len(mates):
                some, mates = mates[:32], mates[32:]
                own, at = hashes[bounds[a] : bounds[a + 1]], np.append(0, np.cumsum(size[some]))
                other = np.concatenate([hashes[bounds[b] : bounds[b + 1]] for b in some])
                shared = np.add.reduceat(own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other, at[:-1], dtype=np.int64)
                for b in some[den * shared >= num * (size[a] + size[some] - shared)].tolist():
                    if part[a] != part[b]:
                        yield min(doc[a], doc[b]), max(doc[a], doc[b])
                        part = np.where(part == part[b], part[a], part)
                mates = mates[part[mates] != part[a]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def flush() -> pa.RecordBatch:
            pairs = list(links(rows)) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([int(p[i]) for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "side", "component", "before", "doc_id", "text")]
            for cluster, i, j, *row in zip(*columns, strict=True):
                if (cluster, i, j) != group:
                    yield flush()
                    group, rows = (cluster, i, j), []
                rows.append(tuple(row))
        yield flush()

    return run


def choose_boundary(sizes: dict[int, int], per_list_row: float, num: int, den: int, most: int = 40) -> int:
    """The largest size below which enumerating subsets costs less than list rows with their candidates.

    sizes: number of sets by size; per_list_row: what a row of an inverted list costs, candidates
    included, when a row of a subset costs 1.
    """
    best, boundary, gain = 0.0, 0, 0.0
    for s in range(1, most + 1):
        listed = s - int(_needed(np.array([s]), num, den)[0]) + 1
        gain += sizes.get(s, 0) * (listed * per_list_row - subset_count(s, num, den))
        if gain > best:
            best, boundary = gain, s
    return boundary


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, num: int = 90, den: int = 100, frequent_from: int = FREQUENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links J >= num/den).

    Words are runs of bytes that aren't white space, A-Z lower-cased. A text of fewer words than
    ngram is one shingle; null, empty and blank texts have none and link with nothing. Ids must be
    whole numbers; rows that repeat an id are one document of the smallest of their non-empty sets (of
    ties, that of the least fingerprint), and each
    such row is returned; rows without id link with nothing and get a null component. A task holds one
    whole text at least, with about 100 bytes for each of its words.
    """
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = stash(texts.mapInArrow(_sketches(ngram, num, den), "doc_id long, n long, k1 long, k2 long, first array<long>"), "sets")
    full = base.filter("n > 0 and doc_id is not null")
    texts, full = _one_set(texts, full, ngram, num, den)
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    reps = stash(classes, "classes")

    # Frequent elements, and what a list row costs.
    counted = full.select("doc_id", F.explode("first").alias("element")).groupBy("element").agg(F.count("*").alias("lists"))
    counted = stash(counted.filter("lists > 1"), "counts")
    figures = counted.agg(F.sum("lists"), F.max("lists")).first()
    floor = max(frequent_from, int((figures[0] or 0) / MOST_FREQUENT))
    frequent = np.sort(np.asarray(counted.filter(F.col("lists") > floor).select("element").toArrow()["element"], dtype=np.int64))
    shared = (figures[0] or 0) / max(1, full.select(F.sum(F.size("first"))).first()[0] or 1)
    sizes = {r["n"]: r["count"] for r in reps.filter("n <= 40").groupBy("n").count().collect()}
    small = choose_boundary(sizes, 1 + 4 * shared, num, den)

    told = spark.sparkContext.broadcast(frequent)
    listed = texts.filter("doc_id is not null").mapInArrow(_listed(ngram, num, den, small, told), "doc_id long, n int, keys array<long>, sketch binary")
    listed = stash(listed.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "lists")
    rows = listed.select("doc_id", "n", F.explode("keys").alias("key"))
    rows = stash(rows.withColumn("size", F.count("*").over(W.partitionBy("key"))).filter("size > 1"), "rows")
    star = rows.select("key", "n", "doc_id").repartition("key").sortWithinPartitions("key", "n", "doc_id").mapInArrow(_pivots(num, den), "a long, b long")
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stash(_verify(star, listed, texts, ngram, num, den), "links")

    # Pairs that no pivot has joined, in lists that still span components.
    longest = rows.groupBy("doc_id").agg(F.max(F.struct("size", "key")).alias("l"), F.first("n").alias("n")).select("l.key", "n", "doc_id", "l.size")
    clusters, parts = None, stash(connected_components(links), "parts")
    for some in (longest, rows):
        forest = stash(_dealt(some, parts, clusters, listed, _crossing(num, den)).distinct(), "forest")
        if not forest.isEmpty():
            before, clusters = clusters, stash(connected_components(forest).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
            links = stash(links.unionByName(_clustered(clusters, before, parts, texts, _compared(ngram, num, den))), "links")
            parts = stash(connected_components(links), "parts")

    component = reps.join(parts, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    own = full.select("doc_id", "k1", "k2").join(component, ["k1", "k2"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return base.select("doc_id", F.col("n").alias("n_shingles")).join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _one_set(texts: DataFrame, full: DataFrame, ngram: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """texts and full (rows with sets) where rows that repeat an id with other sets are left out."""
    own = F.struct("n", "k1", "k2")
    odd = stash(full.groupBy("doc_id").agg(F.min(own).alias("own"), F.max(own).alias("other")).filter("own != other").select("doc_id", "own.*"), "odd")
    if odd.isEmpty():
        return texts, full
    keyed = texts.join(odd.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sketches(ngram, num, den, True), "doc_id long, n long, k1 long, k2 long, first array<long>, text string")
    keyed = keyed.join(odd, ["doc_id", "n", "k1", "k2"], "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"])
    texts = stash(texts.join(odd, "doc_id", "left_anti").select("doc_id", "text").unionByName(keyed), "texts")
    return texts, full.join(odd, "doc_id", "left_anti").unionByName(full.join(odd, ["doc_id", "n", "k1", "k2"], "left_semi").select(full.columns))


def _with_cluster(rows: DataFrame, clusters: DataFrame | None, name: str) -> DataFrame:
    """rows with the document's cluster as name, or its own id if it is in none."""
    if clusters is None:
        return rows.withColumn(name, F.col("doc_id"))
    return rows.join(clusters.withColumnRenamed("cluster", "__cluster"), "doc_id", "left").withColumn(name, F.coalesce("__cluster", "doc_id")).drop("__cluster")


def _read(files: list[str], by: str, key: int, own: int, columns: list[str]) -> list[pa.RecordBatch]:
    """A block of a stashed table from its files; of them only row groups that may hold it are read."""
    out = []
    for file in files:
        store, name = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
        found = pq.read_table(name, filesystem=store, columns=columns, filters=[(by, "=", key), ("own", "=", own)])
        out += found.to_batches(max_chunksize=BATCH_ROWS)
    return out


def _fetched(by: str, columns: list[str], run):
    """mapInArrow over pairs of blocks (by, i, j, files_i, files_j) sorted by i: run over the rows of each pair."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, []
        for batch in batches:
            for key, i, j, files_i, files_j in zip(*(batch.column(c).to_pylist() for c in (by, "i", "j", "files_i", "files_j")), strict=True):
                if (key, i) != held:
                    held, left = (key, i), _read(files_i, by, key, i, columns)
                sides = [(2, left)] if i == j else [(0, left), (1, _read(files_j, by, key, j, columns))]
                for side, rows in sides:
                    for own in rows:
                        told = [pa.array([x] * own.num_rows, kind) for x, kind in ((key, pa.int64()), (i, pa.int32()), (j, pa.int32()), (side, pa.int32()))]
                        yield pa.RecordBatch.from_arrays([*told, *own.columns], [by, "i", "j", "side", *columns])

    return lambda batches: run(pairs(batches))


def _in_blocks(whole: DataFrame, split: DataFrame | None, by: str, columns: list[str], run) -> DataFrame:
    """What run (mapInArrow) tells of the pairs within groups `by`.

    whole: the rows of groups of one block, which come together. split: those of larger groups, with the
    number of their blocks. Each row is written once, blocks apart; tasks are given pairs of blocks by name, up
    to PARTNERS of them for a block, and read these from the shared folder: shuffled rows grow with the rows.
    """
    zero = [F.lit(x).alias(c) for x, c in ((0, "i"), (0, "j"), (2, "side"))]
    out = whole.select(by, *zero, *columns).repartition(by).sortWithinPartitions(by).mapInArrow(run, "a long, b long")
    if split is None:
        return out
    kept = split.select(by, F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("own"), F.col("blocks").cast("int").alias("blocks"), *columns)
    kept = stash(kept.repartition(by, "own").sortWithinPartitions(by, "own"), "blocks", **{"parquet.block.size": ROW_GROUP})
    files = stash(kept.groupBy(by, "own", "blocks").agg(F.sort_array(F.collect_set("_metadata.file_path")).alias("files")), "files")
    ends = [files.select(by, "blocks", F.col("own").alias(c), F.col("files").alias(f"files_{c}")) for c in "ij"]
    # Around the circle of blocks each one meets those of the half that follows it.
    ahead = F.pmod(F.col("j") - F.col("i"), F.col("blocks"))
    pairs = ends[0].join(ends[1].drop("blocks"), by).filter((2 * ahead < F.col("blocks")) | ((2 * ahead == F.col("blocks")) & (F.col("i") < F.col("j"))))
    pairs = stash(pairs.select(by, "i", "j", "files_i", "files_j", (ahead / PARTNERS).cast("int").alias("part")), "tiles")
    tasks = min(pairs.count() // PARTNERS + 1, MOST_TASKS)  # given, as these rows are small: adaptive execution would put them all in one task
    pairs = pairs.repartition(tasks, by, "i", "part").sortWithinPartitions(by, "i", "j")
    return out.unionByName(pairs.mapInArrow(_fetched(by, columns, run), "a long, b long"))


def _clustered(clusters: DataFrame, before: DataFrame | None, parts: DataFrame, texts: DataFrame, run) -> DataFrame:
    """What run tells of the documents of each cluster, with their texts."""
    own = _with_cluster(clusters, before, "before").join(parts, F.col("doc_id") == F.col("node"), "left")
    own = stash(own.select("doc_id", "cluster", "before", F.coalesce("component", "doc_id").alias("component")), "members")
    found = texts.join(own.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    member = stash(own.join(found, "doc_id"), "members")
    blocks = member.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    blocks = stash(blocks.filter("blocks > 1"), "large")
    columns = ["component", "before", "doc_id", "text"]
    if blocks.isEmpty():
        return _in_blocks(member, None, "cluster", columns, run)
    return _in_blocks(member.join(blocks, "cluster", "left_anti"), member.join(blocks, "cluster"), "cluster", columns, run)


def _dealt(rows: DataFrame, parts: DataFrame, clusters: DataFrame | None, listed: DataFrame, run) -> DataFrame:
    """What run tells of the rows of lists that span components and clusters. Lists of two are left out:
    their pair has been compared."""

    def spanning(rows: DataFrame) -> DataFrame:
        member = rows.join(parts, rows["doc_id"] == parts["node"], "left").select("key", "n", "doc_id", "size", F.coalesce("component", "doc_id").alias("component"))
        member = _with_cluster(member, clusters, "cluster")
        spans = [f(c).alias(f"{name}_{c}") for c in ("component", "cluster") for name, f in (("low", F.min), ("high", F.max))]
        split = member.groupBy("key").agg(*spans).filter("low_component != high_component and low_cluster != high_cluster").select("key")
        return member.join(split, "key").join(listed.select("doc_id", "sketch"), "doc_id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))

    long = rows.filter(F.col("size") > BLOCK)
    return _in_blocks(spanning(rows.filter((F.col("size") > 2) & (F.col("size") <= BLOCK))), None if long.isEmpty() else spanning(long), "key", ["n", "component", "cluster", "doc_id", "sketch"], run)


def _verify(pairs: DataFrame, listed: DataFrame, texts: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b) those with J >= t: by sketch first, then by the texts themselves."""
    sketch = listed.select("doc_id", "n", "sketch")
    for side in ("a", "b"):
        pairs = pairs.join(sketch.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = stash(pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_near(num, den), "a long, b long"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    found = stash(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(_linked(ngram, num, den), "a long, b long")
