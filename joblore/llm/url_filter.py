"""URL rules decided by a cascade of Bloom filters.

A URL's keys are those endings of its host and beginnings of its path, joined, that have as many labels and
characters as some rule's host and path. Level 0 of the cascade encodes the listed keys; level 1 those keys of the
corpus that level 0 lets pass by mistake; level 2 the listed keys that level 1 lets pass; and so on
until none is left. Over the corpus's complete key universe the first level that a key
fails then tells exactly whether it is listed, without a join: only filters reach the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblore.llm import fingerprints as fp
from joblore.llm.scratch import free_name, with_fields

#: Bytes of all levels together; they are sent to every task.
MOST_BYTES = 256 << 20


class Level:
    """A Bloom filter over keys of two 64-bit fingerprints (a 2 x n array)."""

    def __init__(self, bits: int, hashes: int, salt: int):
        self.bits, self.hashes, self.salt = max(64, bits), hashes, salt
        self.words = np.zeros(-(-self.bits // 64), np.uint64)

    @staticmethod
    def sized(n: int, rate: float, salt: int) -> Level:
        return Level(ceil(max(1, n) * -log(rate) / log(2) ** 2), max(1, round(-log(rate) / log(2))), salt)

    def places(self, keys: np.ndarray) -> np.ndarray:
        a, b = fp.mix(keys[0] ^ fp.U64(2 * self.salt + 1)), fp.mix(keys[1] ^ fp.U64(2 * self.salt + 2)) | fp.U64(1)
        return np.stack([(a + fp.U64(i) * b) % fp.U64(self.bits) for i in range(self.hashes)])

    def add(self, places: np.ndarray) -> None:
        np.bitwise_or.at(self.words, (places >> fp.U64(6)).astype(np.int64), fp.U64(1) << (places & fp.U64(63)))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        p = self.places(keys)
        return ((self.words[(p >> fp.U64(6)).astype(np.int64)] >> (p & fp.U64(63))) & fp.U64(1)).astype(bool).all(axis=0)


def listed(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that a key fails is odd."""
    out, here = np.zeros(keys.shape[1], bool), np.arange(keys.shape[1])
    for i, level in enumerate(levels):
        passed = level.holds(keys[:, here])
        out[here[~passed]] = i % 2 == 1
        here = here[passed]
    out[here] = len(levels) % 2 == 1
    return out


def _prints(column: pa.Array) -> np.ndarray:
    data, offs = fp.flat(column)
    return np.stack([fp.spans(data, offs[:-1], offs[1:], family) for family in (0, 1)])


def _level(keys: DataFrame, level: Level) -> Level:
    """Fill the level with a column `key`: tasks send the words they have set, OR-ed by Spark."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = level.places(_prints(batch.column("key"))).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((p >> fp.U64(6)).astype(np.int64)), pa.array(fp.signed(fp.U64(1) << (p & fp.U64(63))))], ["word", "bits"])

    got = keys.select("key").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    level.words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return level


def _passing(keys: DataFrame, levels: list[Level]) -> DataFrame:
    told = keys.sparkSession.sparkContext.broadcast(levels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _prints(batch.column("key"))
            yield batch.filter(pa.array(np.logical_and.reduce([x.holds(prints) for x in told.value])))

    return keys.mapInArrow(keep, "key string")


def build_cascade(listed_keys: DataFrame, universe: DataFrame, n_universe: int, most_bytes: int = MOST_BYTES) -> list[Level]:
    """Levels that decide exactly, for each key of the universe and the list (columns `key`), whether it is listed."""
    ins, outs = listed_keys.select("key").distinct(), None
    n = ins.count()
    levels: list[Level] = []
    if not n:
        return levels
    rate = min(0.5, max(1e-9, n / max(1, n_universe) / 2**0.5))
    while n:
        level = Level.sized(n, rate if not levels else 0.5, len(levels))
        if sum(x.words.nbytes for x in [*levels, level]) > most_bytes:
            raise ValueError(f"the filters of {n} keys would take over {most_bytes} bytes")
        levels.append(_level(outs if len(levels) % 2 else ins, level))
        if len(levels) % 2:  # it holds listed keys: whom else does it let pass?
            outs = _passing(universe.select("key") if outs is None else outs, levels).distinct().join(listed_keys.select("key"), "key", "left_anti")
            n = outs.count()
        else:
            ins = _passing(ins, levels)
            n = ins.count()
        if len(levels) > 200:
            raise RuntimeError("two keys have the same 128 bits of fingerprints")
    return levels


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."))) + 1


def _keys(host: Column, path: Column, extents: list[tuple[int, int]]) -> Column:
    """All keys of a URL, the longest first, of equally long ones that of the longest host (the sort keeps their
    order). extents: the rules' numbers of labels and lengths of paths, the most labels first."""
    none = F.array().cast("array<string>")
    fits = lambda labels, length: (_labels(host) >= labels) & (F.char_length(path) >= length)
    keys = [F.when(fits(n, length), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, length))) for n, length in extents]
    keys = F.array_compact(F.array(*keys)) if keys else none
    return F.when(host == "", none).otherwise(F.array_sort(keys, lambda a, b: F.char_length(b) - F.char_length(a)))


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict.

    rules: (host, path, verdict "allow" or "block"). A rule fits its host and all subdomains of it,
    if the path starts with the rule's; of those that fit, the longest text host + path wins, of equally long ones that
    whose host has more labels. Hosts of rules are lower-cased in A-Z, as those of urls are. Where
    none fits, rule is null and the verdict is the default, as no listed key is found; a rule whose path
    is neither empty nor begins with / fits nothing. Null urls and urls
    without :// have an empty host and path, which no rule fits. Of rules that repeat a key, block wins.
    Columns of urls named host, path, rule or verdict are replaced.
    """
    rules = rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict").filter("h is not null and h != '' and (p = '' or startswith(p, '/'))")
    extents = sorted((tuple(r) for r in rules.select(_labels(F.col("h")), F.char_length("p")).distinct().collect()), reverse=True)
    keys = rules.groupBy(F.concat("h", "p").alias("key")).agg(F.max(F.col("verdict") == "block").alias("blocks"))
    out = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    of_url = _keys(F.col("host"), F.col("path"), extents)
    universe = out.select(F.explode(of_url).alias("key"))
    n = universe.agg(F.approx_count_distinct("key")).first()[0]
    any_rule = build_cascade(keys, universe, n)
    blocking = build_cascade(keys.filter("blocks"), keys, len(extents))
    told = urls.sparkSession.sparkContext.broadcast((any_rule, blocking))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_rule, blocking = told.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat, count = column.flatten(), np.diff(column.offsets.to_numpy())
            hit = np.flatnonzero(listed(any_rule, _prints(flat)))
            who, first = np.unique(fp.owners(np.append(0, np.cumsum(count)))[hit], return_index=True)
            best = hit[first]
            rule = np.full(batch.num_rows, -1, np.int64)
            rule[who] = best
            names = flat.take(pa.array(rule, mask=rule < 0))
            verdict = np.full(batch.num_rows, default, dtype=object)
            verdict[who] = np.where(listed(blocking, _prints(flat.take(pa.array(best)))), "block", "allow")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], names.cast(pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names[:-1], "rule", "verdict"])

    schema = with_fields(out.schema, rule=T.StringType(), verdict=T.StringType())
    return out.withColumn(free_name(out, "__keys"), of_url).mapInArrow(decide, schema)
