"""Token ids of documents in binary files: one array of ids, document boundaries in Elias-Fano code.

A file is one block: a header, the documents' ids and the ends of their tokens as two Elias-Fano sequences, and
the tokens concatenated, in two bytes each if the vocabulary allows, else four. Blocks follow the order of
doc_id. A sequence of n numbers below u takes about 2 + log2(u / n) bits a number, and a sample of every 256th place
lets `select` find any of them, so no table of 64-bit offsets is kept. Files are written through Spark's own file
committer: a block ends with a byte 0, which is the text writer's line separator.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.llm.fingerprints import lists, pieces
from joblore.llm.scratch import short_batches, stash
from joblore.llm.warc import _File as File

MAGIC = b"EFTOKEN1"
#: magic, bytes of a token, bytes of a place of the sample, part, block of the part, rows without id, rows, tokens,
#: tokens of the part before, least id, bytes of the sequence of ids, bytes of that of ends.
HEADER = struct.Struct("<8s2B2xI2Q3Qq2Q4x")
#: magic of a sequence, bits of its lower parts, numbers, bytes of lower bits, words of upper bits.
SEQUENCE = struct.Struct("<2sH4xQQQ")
#: Every so many numbers the place of the number's bit is kept.
EVERY = 256
#: Tokens of a block take at most so many bytes, but for a longer document, and it holds at most so many documents.
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1 << 20
END_ID = 2
MANIFEST = "path string, part long, block long, n_docs long, n_tokens long, before long, first_id long, head long"


class EliasFano:
    """A sequence of non-decreasing numbers in [0, 2^63)."""

    def __init__(self, data: bytes):
        magic, self.low_bits, self.n, low, upper = SEQUENCE.unpack_from(data)
        if magic != b"EF":
            raise ValueError("no Elias-Fano sequence")
        at = SEQUENCE.size
        self.low = np.frombuffer(data, np.uint8, low, at)
        self.upper = np.frombuffer(data, "<u8", upper, at + low)
        self.sample = np.frombuffer(data, "<u4", -(-self.n // EVERY), at + low + 8 * upper)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        values = values.astype(np.uint64)
        most = int(values[-1]) if n else 0
        bits = min(56, max(0, (most // n).bit_length() - 1)) if n else 0
        low = values & np.uint64((1 << bits) - 1)
        flags = (low[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(flags.ravel(), bitorder="little").tobytes() + bytes(8)  # to load eight bytes anywhere
        packed += bytes(-len(packed) % 8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) // 64 + 1 if n else 0, np.uint64)
        if n and ones[-1] >> 32:
            raise ValueError("a sequence of a block takes more than 2^32 bits")
        np.bitwise_or.at(upper, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        return SEQUENCE.pack(b"EF", bits, n, len(packed), len(upper)) + packed + upper.astype("<u8").tobytes() + ones[::EVERY].astype("<u4").tobytes()

    def _select(self, i: np.ndarray) -> np.ndarray:
        """The places of the i-th ones among the upper bits: from the sample on, word by word."""
        start = self.sample[i // EVERY].astype(np.int64)
        word, left = start >> 6, i % EVERY
        bits = self.upper[word] & (~np.uint64(0) << (start & 63).astype(np.uint64))
        while True:
            held = np.bitwise_count(bits).astype(np.int64)
            on = np.flatnonzero(held <= left)
            if not len(on):
                break
            left[on] -= held[on]
            word[on] += 1
            bits[on] = self.upper[word[on]]
        flags = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (word << 6) + np.argmax(np.cumsum(flags, axis=1, dtype=np.uint8) > left[:, None], axis=1)

    def select(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers, from 0."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return i
        return (self._select(i) - i << self.low_bits) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        loads = np.ndarray((max(1, len(self.low) - 7),), "<u8", self.low, strides=(1,))
        return (loads[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def all(self) -> np.ndarray:
        """All numbers, in order."""
        ones = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return (ones - i << self.low_bits) | self._low(i)

    def find(self, value: int) -> tuple[int, int]:
        """The range of the places that hold value, by bisection."""
        out = []
        for reach in (value, value + 1):
            low, high = 0, self.n
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if int(self.select(np.array([middle]))[0]) < reach else (low, middle)
            out.append(low)
        return out[0], out[1]


#: How the texts of a file's tokenizer fall into parts that are encoded alone, if its rules are these.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def separable(held: dict) -> bool:
    """Whether a tokenizer's file says that texts are composed (NFC), lower-cased and cut by PARTS, white space being dropped.

    Then a text's tokens are those of its words one after the other, a letter or digit and a following stop or comma can
    be parted, and ASCII words may be lower-cased before.
    """
    normal = (held.get("normalizer") or {}).get("normalizers", [])
    split = (held.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    plain = [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"] and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
    cut = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and split["pattern"] == {"Regex": PARTS}
    bare = all(t["content"].startswith("<") and not (t["normalized"] or t["single_word"] or re.search(r"\s", t["content"])) for t in held["added_tokens"])
    return bool(plain and cut and bare and not held.get("post_processor"))


class Encoder:
    """Tokens of texts. Where texts are separable, distinct words are encoded once and kept; else whole texts are."""

    #: Longer words are not kept; of the others so many are in each of two generations, the older of which goes.
    LONG, KEPT = 64, 400_000

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            self.by_word = separable(json.load(f))
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        pack, code = struct.Struct, "H" if self.width == 2 else "I"
        return [pack(f"<{len(e.ids)}{code}").pack(*e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The tokens of distinct words."""
        if len(self.young) > self.KEPT:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = [young.get(w) for w in words]
        missing = [i for i, ids in enumerate(out) if ids is None]
        fresh = []
        for i in missing:
            if (ids := old.get(words[i])) is None:
                fresh.append(i)
            else:
                out[i] = young[words[i]] = ids
        for first in range(0, len(fresh), 4096):
            some = fresh[first : first + 4096]
            for i, ids in zip(some, self._encoded([words[i] for i in some]), strict=True):
                out[i] = ids
                if len(words[i]) <= self.LONG:
                    young[words[i]] = ids
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            ids = self._encoded(texts.to_pylist())
            return np.frombuffer(b"".join(ids), self.kind), np.array([len(x) for x in ids], np.int64) // self.width
        parts = pc.split_pattern_regex(pc.replace_substring_regex(texts, r"([A-Za-z0-9])([.,;:!?])", r"\1 \2"), r"[\x09-\x0D\x20]+")
        spelled = pc.dictionary_encode(pc.list_flatten(parts))
        words = spelled.dictionary
        small = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<")))
        words = pc.dictionary_encode(pc.if_else(small, pc.ascii_lower(words), words))
        index = words.indices.to_numpy()[spelled.indices.to_numpy()]
        ids = self._words(words.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        first = np.cumsum(size) - size
        own = size[index]
        upto = np.cumsum(own)
        take = np.repeat(first[index] - (upto - own), own) + np.arange(own.sum())
        bounds = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy()))
        return np.frombuffer(b"".join(ids), self.kind)[take], np.diff(np.append(0, upto)[bounds])


@functools.lru_cache(maxsize=2)
def _encoder(file: str) -> Encoder:
    """The worker's encoder of a file: the words that it knows stay from task to task."""
    return Encoder(file)


def block(width: int, part: int, number: int, nulls: int, ids: np.ndarray, ends: np.ndarray, tokens: Sequence[bytes], before: int) -> bytes:
    """The bytes of a block but for its last one, 0. ids don't decrease; rows without id come first and are none of them."""
    least = int(ids[0]) if len(ids) else 0
    names, bounds = EliasFano.encode(ids.view(np.uint64) - np.int64(least).view(np.uint64)), EliasFano.encode(ends)
    head = HEADER.pack(MAGIC, width, 4, part, number, nulls, nulls + len(ids), int(ends[-1]) if len(ends) else 0, before, least, len(names), len(bounds))
    return b"".join([head, names, bounds, *tokens])


class Block:
    """Reads a block's parts when they are asked for."""

    def __init__(self, path: str):
        self.file = File(path)
        head = self.file.read(0, HEADER.size)
        if len(head) < HEADER.size or not head.startswith(MAGIC):
            raise ValueError(f"{path} is no file of tokens")
        _, self.width, _, self.part, self.number, self.nulls, self.n_docs, self.n_tokens, self.before, self.least, names, bounds = HEADER.unpack(head)
        self.places = HEADER.size, HEADER.size + names, HEADER.size + names + bounds
        if self.file.size != self.places[2] + self.n_tokens * self.width + 1:
            raise ValueError(f"{path} has not the length that its header says")

    @functools.cached_property
    def ids(self) -> EliasFano:
        return EliasFano(self.file.read(self.places[0], self.places[1] - self.places[0]))

    @functools.cached_property
    def ends(self) -> EliasFano:
        return EliasFano(self.file.read(self.places[1], self.places[2] - self.places[1]))

    def doc_ids(self, i: np.ndarray) -> np.ndarray:
        """The ids of the rows i that have one."""
        return (self.ids.select(i - self.nulls).view(np.uint64) + np.int64(self.least).view(np.uint64)).view(np.int64)

    def rows_of(self, doc_id: int) -> range:
        if doc_id < self.least:
            return range(0)
        first, last = self.ids.find(doc_id - self.least)
        return range(self.nulls + first, self.nulls + last)

    def bounds(self, i: int) -> tuple[int, int]:
        """The places, in the block, of a row's tokens."""
        at = self.ends.select(np.array([i - 1, i] if i else [0]))
        return (int(at[0]) if i else 0), int(at[-1])

    def tokens(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read(self.places[2] + start * self.width, (end - start) * self.width), f"<u{self.width}")


def _blocks(file: str, end_id: int, block_bytes: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number, before = _encoder(file), TaskContext.get().partitionId(), 0, 0
        names, sizes, tokens, held, docs = [], [], [], 0, 0

        def packed() -> pa.RecordBatch:
            own = pa.concat_arrays(names)
            ids = own.drop_null().to_numpy()
            ends = np.cumsum(np.concatenate(sizes))
            data = block(encode.width, part, number, own.null_count, ids, ends, tokens, before)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.large_binary())], ["block"])

        for batch in pieces(batches, "text", 2 << 20):
            ids, n = encode(batch.column("text"))
            out = np.insert(ids, np.cumsum(n), end_id)
            n += 1
            upto = np.append(0, np.cumsum(n))
            at = 0
            while at < len(n):
                room = (block_bytes - held) // encode.width
                last = int(np.searchsorted(upto, upto[at] + room, "right")) - 1
                last = min(max(last, at + (docs == 0)), at + block_docs - docs)
                if last > at:
                    names.append(batch.column("doc_id").slice(at, last - at))
                    sizes.append(n[at:last])
                    tokens.append(out[upto[at] : upto[last]].tobytes())
                    held, docs, at = held + len(tokens[-1]), docs + last - at, last
                if at < len(n):
                    yield packed()
                    number, before = number + 1, before + held // encode.width
                    names, sizes, tokens, held, docs = [], [], [], 0, 0
        if docs:
            yield packed()

    return run


def write_tokens(docs: DataFrame, path: str, file: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> None:
    """Encode each text with the tokenizer of the file, add end_id, and write all to new files in the folder path.

    Rows are in ascending order of doc_id, those without one first; rows that repeat a doc_id follow each other in an order that
    their texts fix. A null text is empty: it has the end id alone. Ids are whole numbers. An empty table makes a folder without blocks.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    blocks = rows.mapInArrow(_blocks(file or public_tokenizers.path("word_bpe_49k.json"), end_id, block_bytes, block_docs), "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    for batch in batches:
        rows = [(p, b.part, b.number, b.n_docs, b.n_tokens, b.before, b.least, b.places[2]) for p in batch.column("path").to_pylist() for b in [Block(p)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names) if rows else pa.RecordBatch.from_pylist([], pa.schema([(n, pa.string() if n == "path" else pa.int64()) for n in names]))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a folder in MANIFEST's columns, and start, the tokens of all blocks before. Only headers are read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0").select("path")
    heads = stash(files.mapInArrow(_heads, MANIFEST), "manifest")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("own"))  # one row for each task that wrote
    parts = parts.select("part", (F.sum("own").over(W.orderBy("part")) - F.col("own")).alias("earlier"))
    return heads.join(F.broadcast(parts), "part").withColumn("start", F.col("earlier") + F.col("before")).drop("earlier")


def _documents(with_ids: bool, schema: pa.Schema, step: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                own = Block(path)
                ends = own.ends.all()
                names = own.ids.all() if own.n_docs > own.nulls else np.zeros(0, np.int64)
                names = (names.view(np.uint64) + np.int64(own.least).view(np.uint64)).view(np.int64)
                names = pa.concat_arrays([pa.nulls(own.nulls, pa.int64()), pa.array(names)])
                starts, at = np.append(0, ends[:-1]), 0
                while at < own.n_docs:  # some documents at a time
                    last = max(at + 1, int(np.searchsorted(ends, starts[at] + step, "right")))
                    tokens = own.tokens(int(starts[at]), int(ends[last - 1])).astype("<u4")
                    data, inner = memoryview(tokens).cast("B"), (starts[at:last] - starts[at]).tolist()
                    sizes = ends[at:last] - starts[at:last]
                    crc = [zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(inner, sizes.tolist(), strict=True)]
                    columns = [names.slice(at, last - at), pa.array(starts[at:last] + base), pa.array(sizes), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(lists(tokens.astype(np.int32), sizes, pa.int32()))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    at = last

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document of a folder: start counts the ids of all documents before
    it, ids_crc32 is the CRC of its ids as little-endian 32-bit numbers. Without with_ids the ids are checked but not returned."""
    files = manifest(spark, path).select("path", "start")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c, _ in kinds)
    tasks = max(1, files.count())  # given, as the rows are small: adaptive execution would put them all in one task
    return files.repartition(tasks, "path").mapInArrow(_documents(with_ids, pa.schema(kinds)), schema)


def lookup(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """(doc_id, start, ids) of some documents, as few as a list can hold: each block is asked for them through its
    sequences, and of its tokens only theirs are read."""
    wanted = sorted({int(x) for x in doc_ids})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                own = Block(file)
                for doc_id in wanted:
                    for i in own.rows_of(doc_id):
                        start, end = own.bounds(i)
                        yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "start": [base + start], "ids": pa.array([own.tokens(start, end).tolist()], pa.list_(pa.int32()))})

    return manifest(spark, path).select("path", "start").mapInArrow(run, "doc_id long, start long, ids array<int>")
