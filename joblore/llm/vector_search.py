"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector o of length |o| is rotated at random and kept as the signs of its coordinates, packed as
bits, and two numbers: |o| and c = <sign code, o / |o|>. For a rotated unit query q the quotient
<sign code, q> / c estimates <o / |o|, q> without bias, and its error exceeds
e * sqrt((1 - c^2) / c^2 / (bits - 1)) with a probability that falls like exp(-e^2 / 2). Vectors
whose upper bound reaches the k-th best score are ranked again by their exact inner products.

Queries go to the index, in groups of bounded size: each task keeps the k best that it has ranked for
each query, and what it has yet to see must reach the last of them with its upper bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.llm.scratch import new_path, stash

INDEX = "vec_id long, vector array<double>, dim int, code binary, norm double, fit double"


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """A dim x bits matrix with orthonormal rows: zeros pad the vector, then a random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


#: Lengths of a query times a vector between which bounds are told in doubles; beyond, every product is computed.
RANGE = 1e-250, 1e250


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 and their lengths; squares of very small or large numbers would leave the range of doubles."""
    scale = np.abs(x).max(axis=1)
    unit = x / scale[:, None]
    length = np.linalg.norm(unit, axis=1)
    with np.errstate(over="ignore"):
        return unit / length[:, None], length * scale


def _width(dim: int, least: int) -> int:
    return max(least, -(-dim // 8) * 8)


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): one row per id (the least of repeated ones), without vectors that are null,
    empty, zero, or hold null or non-finite components."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrices(batch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each dimension."""
    lists = batch.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield at, flat[start[at][:, None] + np.arange(dim)]


def build_index(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 256, seed: int = 7) -> DataFrame:
    """The index of all valid vectors (see INDEX and valid_vectors), a table in the shared folder.

    Vectors of any dimension may mix; only those of one dimension are comparable. Codes have
    `bits` bits, or one for each dimension if those are more.
    """
    rows = valid_vectors(rows, id_col, vector_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, "vector"):
                unit, norm = _units(x)
                width = _width(x.shape[1], bits)
                turned = unit @ rotation(x.shape[1], width, seed)
                ones = turned > 0
                fit = np.abs(turned).sum(axis=1) / width**0.5
                code = np.packbits(ones, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(at)), batch.column("vector").take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], np.int32)),
                        pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(fit),
                    ],
                    ["vec_id", "vector", "dim", "code", "norm", "fit"],
                )

    return stash(rows.mapInArrow(encode, INDEX), "index")


def _ordered_sums(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    out = np.zeros(len(rows))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        for i in range(len(query)):
            out += rows[:, i] * query[i]
    return out


class _Nearest:
    """The k best so far of each of some queries of one dimension, over blocks of the index."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, bits: int, seed: int, error: float):
        self.ids, self.q, self.k, self.error, self.width = ids, q, k, error, _width(q.shape[1], bits)
        unit, self.length = _units(q)
        self.turned = (unit @ rotation(q.shape[1], self.width, seed)).astype(np.float32)
        self.held = np.zeros(len(q), np.int64)
        self.score, self.found = np.empty((len(q), k)), np.empty((len(q), k), np.int64)

    def rank(self, i: int, ids: np.ndarray, x: np.ndarray) -> None:
        """Rank vectors by their exact inner products with query i, among the best so far."""
        n = self.held[i]
        score, found = np.append(self.score[i, :n], _ordered_sums(x, self.q[i])), np.append(self.found[i, :n], ids)
        order = np.lexsort((found, -score))[: self.k]  # NaN comes last
        self.held[i] = n = len(order)
        self.score[i, :n], self.found[i, :n] = score[order], found[order]

    def add(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> None:
        """Rank those of a block that may be among the best. Bounds are of cosines; the last of the best is divided by both
        lengths, and where their product is beyond RANGE nothing is left out."""
        signs = np.unpackbits(code, axis=1)[:, : self.width].astype(np.float32) * 2 - 1
        slack = self.error * np.sqrt(np.maximum(0, 1 - fit**2) / fit**2 / max(1, self.width - 1)) + 1e-5  # float32 below
        for first in range(0, len(self.q), 256):
            cosine = (self.turned[first : first + 256] @ signs.T) / np.float32(self.width**0.5) / fit.astype(np.float32)
            for i, own in enumerate(cosine, first):
                with np.errstate(over="ignore", under="ignore"):
                    product = self.length[i] * norm
                plain = (product > RANGE[0]) & (product < RANGE[1])
                open_ = ids != self.ids[i]
                if self.held[i] < self.k:  # the likeliest first, so that there is a score to beat
                    likely = np.where(plain & open_, own * np.where(plain, product, 0.0), -np.inf)
                    some = np.argpartition(-likely, min(4 * self.k, len(own)) - 1)[: 4 * self.k]
                    some = some[open_[some]]
                    self.rank(i, ids[some], x[some])
                    open_[some] = False
                if self.held[i] == self.k and not np.isnan(self.score[i, -1]):
                    reach = own + slack >= self.score[i, -1] / np.where(plain, product, 1.0)
                    open_ &= reach | ~plain
                again = np.flatnonzero(open_)
                if len(again):
                    self.rank(i, ids[again], x[again])


def search(index: DataFrame, queries: DataFrame, k: int = 20, bits: int = 256, seed: int = 7, error: float = 4.0, query_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (columns vec_id, vector) the k rows of the
    index with the largest inner products, its own vec_id left out; ties go to the smaller vec_id.

    Vectors may have any lengths: scores that leave the range of doubles are 0, infinite or NaN as double precision has them, NaN
    last, and are ranked as such. bits and seed are those of the index. error is the e of the bounds: at 4 about one in 30,000
    vectors of the result may be missed. Queries without a valid vector have no rows, one of repeated
    vec_ids counts (see valid_vectors). About query_rows queries at a time are sent to the tasks, each of which
    goes through its part of the index where it lies; only its best k for each query are shuffled.
    """
    spark = index.sparkSession
    asked = stash(valid_vectors(queries, "vec_id", "vector"), "queries")
    groups = max(1, -(-asked.count() // query_rows))
    out, top = new_path(spark, "nearest"), "query_id long, vec_id long, score double"
    for group in range(groups):
        table = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == group).toArrow()
        told = spark.sparkContext.broadcast([(table["vec_id"].to_numpy()[at], q) for at, q in _matrices(table, "vector")])

        def best(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            nearest = {q.shape[1]: _Nearest(ids, q, k, bits, seed, error) for ids, q in told.value}
            for batch in batches:
                for at, x in _matrices(batch, "vector"):
                    if own := nearest.get(x.shape[1]):
                        code = np.frombuffer(b"".join(batch.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                        own.add(batch.column("vec_id").to_numpy()[at], x, code, batch.column("norm").to_numpy()[at], batch.column("fit").to_numpy()[at])
            for own in nearest.values():
                i, j = np.nonzero(np.arange(k) < own.held[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(own.ids[i]), pa.array(own.found[i, j]), pa.array(own.score[i, j])], ["query_id", "vec_id", "score"])

        near = index.select("vec_id", "vector", "code", "norm", "fit").mapInArrow(best, top)
        order = W.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")  # Spark keeps the first k of each task before the shuffle, too
        near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).write.parquet(f"{out}/group={group}")
    return spark.read.schema(f"{top}, rank int").parquet(*(f"{out}/group={g}" for g in range(groups))).select("query_id", "rank", "vec_id", "score")
