"""Removal of passages that an earlier document holds, by distributed prefix doubling.

The rank of a position is a fingerprint of the bytes that start there, so equal ranks are equal
prefixes, wherever they are computed, and the pair of ranks at p and at p + offset ranks a prefix
longer by the offset. Inside tasks offsets grow to most of the threshold; from there on Spark sorts:

1. A filter. Of the prefixes of three fifths of that length that lie in a string of `length` bytes (a window)
   winnowing picks the least rank, and content cuts each text into blocks of windows. Spark brings equal
   ranks of picks, and equal ones of blocks, together and counts them. A window stays open only if its
   pick occurs more often than its block: otherwise each occurrence of the pick, and so of the window,
   lies in the same place of that block, and what holds for the block holds for it. Unique ones drop out,
   and those of which all places are in one batch are decided there.
2. The table (batch, place, rank pair) of the open windows, one row for each distinct pair of a batch, is
   sorted by rank pair and batch: each row but a pair's first has an earlier holder.

Batches are ranges of doc_id with about equal bytes, so "an earlier document" means an earlier batch or,
within the batch, a smaller doc_id, and however often a passage repeats, a batch sends its rank once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.llm import fingerprints as fp
from joblore.llm.scratch import arrow_function, short_batches

BLOCKS, PICKS = 0, 1
#: Bytes of a rank that are compared; the bucket fixes further bits. Picks that collide only keep windows open.
WIDTH = {BLOCKS: 8, PICKS: 4}
#: A block of windows ends at one position in so many, chosen by content: shorter blocks are more ranks
#: to exchange, and fewer open windows where a passage ends inside a block.
BLOCK = 32
#: Bytes of text that one numpy step takes; longer texts are cut, with length - 1 bytes of overlap.
PIECE = 1 << 18
#: Batches at most (8 bytes each are sent to the tasks); of more text the batches grow.
MOST_BATCHES = 4_000_000
#: In a reply, the bit that says that an earlier batch holds the rank; the others count it.
EARLIER = np.uint32(1 << 31)
MANY = np.uint32(EARLIER - np.uint32(1))


class _Part:
    """Texts, or a piece of a long one, that one numpy step takes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, ids: np.ndarray, rows: np.ndarray, base: int, length: int):
        self.data, self.offs, self.ids, self.rows, self.base = data, offs, ids, rows, base
        self.length, self.prefix = length, length * 3 // 5
        self.windows = max(0, len(data) - length + 1)

    def valid(self) -> np.ndarray:
        """The windows that lie within one text."""
        end = np.repeat(self.offs[1:], np.diff(self.offs))
        return np.arange(self.windows) + self.length <= end[: self.windows]

    def owner(self) -> np.ndarray:
        """The doc_id of each place."""
        return np.repeat(self.ids, np.diff(self.offs))

    def ranks(self) -> np.ndarray:
        return fp.byte_grams(self.data, self.prefix)

    def cuts(self, ranks: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Where blocks of windows start."""
        cut = valid & ((ranks[: self.windows] >> fp.U64(20)) % fp.U64(BLOCK) == 0)
        cut[self.offs[:-1][np.diff(self.offs) >= self.length]] = True
        return cut

    def blocks(self, ranks: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the blocks, and two fingerprints of the bytes they span."""
        start = np.flatnonzero(cut)
        if not len(start):
            return start, np.zeros(0, fp.U64), np.zeros(0, fp.U64)
        last = np.repeat(self.offs[1:], np.diff(self.offs))[start] - self.length + 1
        end = np.minimum(np.append(start[1:], self.windows), last)
        place = np.arange(self.windows) - start[np.maximum(np.cumsum(cut) - 1, 0)]
        mixed = fp.mix(ranks[: self.windows] + place.astype(fp.U64) * fp.U64(0xC2B2AE3D27D4EB4F))
        edges = np.stack([start, end], axis=1).ravel()
        edges = edges[:-1] if edges[-1] == self.windows else edges
        # The prefixes of the block's windows, and what follows them in the last one.
        tail = ranks[end - 1 + self.length - self.prefix]
        a, b = (fp.paired(f.reduceat(mixed, edges)[::2], tail) for f in (np.add, np.bitwise_xor))
        return start, a, b

    def picks(self, ranks: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where picks are, and the place of each window's pick."""
        places = fp.places_of_minima(ranks, self.length - self.prefix + 1)
        marked = np.zeros(len(ranks), bool)
        marked[places[valid]] = True
        return np.flatnonzero(marked), places


def _opened(docs: pa.Table) -> pa.Table:
    """The documents of a batch by doc_id, their texts as bytes."""
    docs = docs.sort_by("doc_id")
    texts = [pa.decompress(x, n, codec="zstd", asbytes=True) if n else b"" for x, n in zip(docs["packed"].to_pylist(), docs["size"].to_pylist(), strict=True)]
    return docs.append_column("text", pa.array(texts, pa.large_binary()))


def _packed(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes, then all second ones and so on, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(kind).ravel() if n else np.zeros(0, kind)


def _parts(docs: pa.Table, length: int) -> Iterator[_Part]:
    """The parts of a batch sorted by doc_id."""
    data, offs = fp.flat(docs["text"])
    ids = docs["doc_id"].to_numpy()
    size = np.diff(offs)
    group = np.cumsum(size) // PIECE
    cuts = np.flatnonzero((np.diff(group) > 0) | (size[1:] > PIECE) | (size[:-1] > PIECE)) + 1 if len(size) else []
    for x, y in zip(np.append(0, cuts).astype(int), np.append(cuts, len(size)).astype(int), strict=True):
        if y - x == 1 and size[x] > PIECE:
            for at in range(0, max(1, int(size[x]) - length + 1), PIECE):
                own = data[offs[x] + at : min(offs[x + 1], offs[x] + at + PIECE + length - 1)]
                yield _Part(own, np.array([0, len(own)]), ids[x:y], np.array([x]), at, length)
        elif y > x:
            yield _Part(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], ids[x:y], np.arange(x, y), 0, length)


class _Ranks:
    """Distinct ranks of a batch, sorted by bucket, with the least doc_id and the number of places of each.

    ids must ascend.
    """

    def __init__(self, kind: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray, buckets: int):
        value = a & fp.U64((1 << 8 * WIDTH[kind]) - 1)
        bucket = ((b if kind != PICKS else a) >> fp.U64(40)) % fp.U64(buckets)
        order = np.lexsort((value, bucket))  # stable, so doc_ids of one rank still ascend
        value, bucket, ids, self.kind = value[order], bucket[order].astype(np.int32), ids[order], kind
        new = np.append(True, (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1]))[: len(value)]
        first = np.flatnonzero(new)
        self.of = np.empty(len(value), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.value, self.bucket, self.least = value[first], bucket[first], ids[first]
        self.count = np.diff(np.append(first, len(value))).astype(np.uint32)

    def rows(self, batch: int) -> pa.Table:
        bounds = np.append(np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])[: len(self.bucket)]), len(self.bucket))
        lists = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        ranks, counts = [_packed(np.diff(self.value[i:j], prepend=fp.U64(0))) for i, j in lists], [_packed(self.count[i:j]) for i, j in lists]
        n = len(ranks)
        return pa.table(
            {
                "kind": pa.array(np.full(n, self.kind, np.int32)), "bucket": pa.array(self.bucket[bounds[:-1]], pa.int32()), "batch": pa.array(np.full(n, batch, np.int32)),
                "n": pa.array(np.diff(bounds), pa.int32()), "ranks": pa.array(ranks, pa.binary()), "counts": pa.array(counts, pa.binary()),
            }
        )

    def told(self, replies: dict) -> np.ndarray:
        """What the buckets have told this batch of each of its distinct ranks."""
        lists = zip(*np.unique(self.bucket, return_counts=True), strict=True)
        return np.concatenate([np.zeros(0, np.uint32), *(_unpacked(replies[self.kind, int(b)], int(n), np.uint32) for b, n in lists)])


def _joined(found: list[tuple]) -> tuple:
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _filter_ranks(docs: pa.Table, length: int, buckets: int) -> tuple[_Ranks, _Ranks]:
    blocks, picks = [], []
    for part in _parts(docs, length):
        ranks, valid, owner = part.ranks(), part.valid(), part.owner()
        start, a, b = part.blocks(ranks, part.cuts(ranks, valid))
        blocks.append((a, b, owner[start]))
        at, _ = part.picks(ranks, valid)
        picks.append((ranks[at], owner[at]))
    a, ids = _joined(picks)
    return _Ranks(BLOCKS, *_joined(blocks), buckets), _Ranks(PICKS, a, a, ids, buckets)


def _first(length: int, buckets: int):
    """Per batch: the ranks of its blocks and picks."""

    def run(docs: pa.Table) -> pa.Table:
        batch, docs = docs["batch"][0].as_py(), _opened(docs)
        return pa.concat_tables([x.rows(batch) for x in _filter_ranks(docs, length, buckets)])

    return run


def _judge(table: pa.Table) -> pa.Table:
    """Per bucket: tells each batch how often each of its ranks occurs, and whether in an earlier batch."""
    table = table.sort_by("batch")
    size = table["n"].to_numpy()
    value = np.concatenate([np.cumsum(_unpacked(x, n, np.uint64), dtype=np.uint64) for x, n in zip(table["ranks"].to_pylist(), size.tolist(), strict=True)])
    counts = np.concatenate([_unpacked(x, n, np.uint32) for x, n in zip(table["counts"].to_pylist(), size.tolist(), strict=True)])
    order = np.argsort(value, kind="stable")
    new = np.append(True, value[order][1:] != value[order][:-1])[: len(value)]
    first = np.flatnonzero(new)
    total = np.minimum(np.add.reduceat(counts[order], first, dtype=np.uint64), MANY).astype(np.uint32)
    out = np.empty(len(value), np.uint32)
    out[order] = total[np.cumsum(new) - 1] | np.where(new, np.uint32(0), EARLIER)
    ends = np.cumsum(size)
    told = [_packed(out[e - c : e]) for e, c in zip(ends.tolist(), size.tolist(), strict=True)]
    return pa.table({"batch": table["batch"], "kind": table["kind"], "bucket": table["bucket"], "told": pa.array(told, pa.binary())})


def _deltas(*columns: np.ndarray) -> bytes:
    """Numbers that mostly grow by one, as compressed differences."""
    data = b"".join(len(c).to_bytes(8, "little") + np.diff(c, prepend=0).astype(np.int32).tobytes() for c in columns)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _sums(data: bytes) -> list[np.ndarray]:
    data, out, at = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.cumsum(np.frombuffer(data, np.int32, n, at + 8), dtype=np.int64))
        at += 8 + 4 * n
    return out


#: own: the lower 24 bits are the second part of the rank pair's fingerprint, the upper ones the place.
WINDOWS = "batch int, first long, own long, state binary"


def _second(length: int, buckets: int):
    """Per batch: the distinct rank pairs of the windows that the filter leaves open and whose picks other
    batches hold, with their number in the batch as place; and one row with the state: the windows that
    are settled, and the open ones with the numbers of their pairs."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        docs = _opened(docs)
        replies = dict(zip(zip(told["kind"].to_pylist(), told["bucket"].to_pylist(), strict=True), told["told"].to_pylist(), strict=True))
        blocks, picks = _filter_ranks(docs, length, buckets)
        of_block, of_pick = (x.told(replies) for x in (blocks, picks))
        held, found, done, seen, before = [], [], 0, 0, 0
        for part in _parts(docs, length):
            ranks, valid, owner = part.ranks(), part.valid(), part.owner()
            cut, (at, places) = part.cuts(ranks, valid), part.picks(ranks, valid)
            own = blocks.of[done : done + np.count_nonzero(cut)]
            times, here = np.zeros(len(ranks), np.uint32), np.zeros(len(ranks), np.uint32)
            times[at] = of_pick[picks.of[seen : seen + len(at)]] & MANY
            here[at] = picks.count[picks.of[seen : seen + len(at)]]
            done, seen = done + len(own), seen + len(at)
            if len(own):
                block = np.maximum(np.cumsum(cut) - 1, 0)
                settled = ((of_block[own] & EARLIER) > 0) | (blocks.least[own] < owner[: part.windows][cut])
                held.append(settled[block] & valid)
                some = np.flatnonzero(valid & ~held[-1] & (times[places] != (of_block[own] & MANY)[block]))
            else:
                held.append(np.zeros(part.windows, bool))
                some = np.zeros(0, np.int64)
            x, y = ranks[some], ranks[some + length - part.prefix]
            found.append((some + before, fp.paired(x, y), fp.paired(y, ~x) >> fp.U64(40), owner[some], (times != here)[places[some]]))
            before += part.windows
        some, first, second, ids, sent = _joined(found)
        held = np.concatenate(held)
        order = np.lexsort((second, first))
        new = np.append(True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1]))[: len(order)]
        leader = order[new]  # the sort is stable: the least doc_id
        number = np.full(len(leader), -1)
        to = np.argsort(leader)
        to = to[sent[leader[to]]]
        number[to] = np.arange(len(to))  # by first place, so that neighbours have neighbouring numbers
        of, mine = np.empty(len(order), np.int64), np.empty(len(order), bool)
        of[order] = number[np.cumsum(new) - 1]
        mine[order] = ids[order] > ids[leader][np.cumsum(new) - 1]
        leader = leader[to]
        held[some[mine]] = True
        turns = np.flatnonzero(np.diff(held, prepend=False, append=False))
        rest = ~mine & sent
        state = _deltas(turns, some[rest], of[rest])
        batch, n = docs["batch"][0].as_py(), len(leader)
        return pa.table(
            {
                "batch": pa.array(np.full(n + 1, batch, np.int32)), "first": pa.array(np.append(fp.signed(first[leader]), batch)),
                "own": pa.array(np.append(fp.signed(second[leader] | np.arange(n, dtype=fp.U64) << fp.U64(24)), -1)), "state": pa.array([None] * n + [state], pa.binary()),
            }
        )

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, rest "


def _cut(length: int, keep_text: bool):
    """Per batch: the documents without the bytes that earlier ones hold."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        docs = _opened(docs)
        turns, some, of = _sums(told["state"][0].as_py())
        earlier = np.zeros(int(of.max(initial=-1)) + 1, bool)
        earlier[told["places"].combine_chunks().flatten().to_numpy()] = True
        held = np.zeros(sum(p.windows for p in _parts(docs, length)) + 1, np.int8)
        held[turns[::2]], held[turns[1::2]] = 1, -1
        held = np.cumsum(held[:-1]).astype(bool)
        held[some[earlier[of]]] = True
        rows, before, whole = [], 0, None
        for part in _parts(docs, length):
            edge = np.zeros(len(part.data) + 1, np.int32)
            own = held[before : before + part.windows].astype(np.int32)
            before += part.windows
            edge[: len(own)] += own
            edge[length : length + len(own)] -= own
            gone = np.cumsum(edge[:-1]) > 0
            for i, row in enumerate(part.rows.tolist()):
                data, cut = part.data[part.offs[i] : part.offs[i + 1]], gone[part.offs[i] : part.offs[i + 1]]
                text = docs["text"][row].as_buffer() if part.base or len(data) > PIECE else None
                if text is not None and (part.base or text.size > len(data)):  # a piece of a long text: its overlap belongs to both
                    data = np.frombuffer(text, np.uint8)
                    whole = np.zeros(len(data), bool) if not part.base else whole
                    whole[part.base : part.base + len(cut)] |= cut
                    if part.base + len(cut) < len(data):
                        continue
                    cut = whole
                kept = data[~cut].tobytes()
                spans = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + (len(cut) and cut[0]))
                rows.append((int(part.ids[i]), len(data), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), _text(data, cut) if keep_text else None))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))}).append_column("rest", docs["rest"])

    return run


def _text(data: np.ndarray, cut: np.ndarray) -> str:
    """What is left as text: a character stays whole when any of its bytes stays."""
    if not len(data):
        return ""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    stays = np.logical_or.reduceat(~cut, first)
    return data[np.repeat(stays, np.diff(np.append(first, len(data))))].tobytes().decode()


def _batches(known: DataFrame, total: int, batch_bytes: int) -> DataFrame:
    """known with the number of its batch, which grows with doc_id, and its text compressed, as batches
    are shuffled and gone through three times. Sorted in ranges, ids and lengths
    alone tell where about batch_bytes are full; a batch begins there or where a range does."""

    def edges(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, 0, []
        for batch in rows:
            for doc, size in zip(batch.column("doc_id").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if last is None or (doc != last and held + size > batch_bytes):
                    out.append(doc)
                    held = 0
                last, held = doc, held + size
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["edge"])

    batch_bytes = max(batch_bytes, total // MOST_BATCHES + 1)
    slim = known.select("doc_id", F.octet_length("text").cast("long").alias("size"))
    begins = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(edges, "edge long").toArrow()["edge"].to_numpy()
    told = known.sparkSession.sparkContext.broadcast(np.sort(begins))

    def dealt(rows: pa.StructArray) -> pa.StructArray:
        ids, texts = rows.field("doc_id").to_numpy(zero_copy_only=False), rows.field("text").cast(pa.large_binary()).to_pylist()
        batch = np.searchsorted(told.value, ids, "right").astype(np.int32) - 1
        packed = [pa.compress(x, codec="zstd", asbytes=True) if x else b"" for x in texts]
        return pa.StructArray.from_arrays([pa.array(batch, pa.int32()), pa.array([len(x) for x in texts], pa.int32()), pa.array(packed, pa.binary())], ["batch", "size", "packed"])

    own = arrow_function(dealt, "struct<batch: int, size: int, packed: binary>")(F.struct("doc_id", "text"))
    return known.withColumn("own", own).select("doc_id", "own.*", "rest")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, keep_text: bool = True, carry: tuple[str, ...] = (), batch_bytes: int = 4 << 20,
) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; text if asked for; and a
    struct `rest` of the columns to carry, if any.

    A byte goes if a string of `length` bytes (16 at least) that covers it also starts in a document of
    smaller doc_id. The digest is of the remaining bytes; text keeps the characters of which a byte remains.
    A null text is empty. Rows that repeat a doc_id don't remove from each other, and rows without
    doc_id neither lose bytes nor make others lose them. A batch holds about batch_bytes of text, or one
    longer text, which a task holds with about 10 bytes for each of its bytes. Equal ranks of 88 bits
    count as equal strings.
    """
    if length < 16:
        raise ValueError("passages must have at least 16 bytes")
    short_batches(docs.sparkSession)
    rest = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rest.alias("rest"))
    known, unknown = rows.filter("doc_id is not null"), rows.filter("doc_id is null")
    length_of = F.octet_length("text").cast("long")
    total = known.agg(F.sum(length_of)).first()[0]
    out = unknown.select(
        "doc_id", length_of.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), (F.col("text") if keep_text else F.lit(None).cast("string")).alias("text"), "rest",
    )
    if total is not None:
        buckets = max(1, -(-total // (16 << 20)))
        known = _batches(known, total, batch_bytes)
        ranks = known.groupBy("batch").applyInArrow(_first(length, buckets), "kind int, bucket int, batch int, n int, ranks binary, counts binary")
        told = ranks.groupBy("kind", "bucket").applyInArrow(_judge, "batch int, kind int, bucket int, told binary")
        windows = known.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_second(length, buckets), WINDOWS)
        order = F.row_number().over(W.partitionBy("first", F.col("own").bitwiseAND((1 << 24) - 1)).orderBy("batch"))
        earlier = windows.withColumn("order", order).filter("order > 1 or state is not null")
        place = F.when(F.col("state").isNull(), F.shiftright("own", 24).cast("int"))
        earlier = earlier.groupBy("batch").agg(F.collect_list(place).alias("places"), F.max("state").alias("state"))  # lists are begun before the shuffle
        cut = known.groupBy("batch").cogroup(earlier.groupBy("batch")).applyInArrow(_cut(length, keep_text), OUT + rows.schema["rest"].dataType.simpleString())
        out = cut.unionByName(out)
    return out.drop(*([] if keep_text else ["text"]), *([] if carry else ["rest"]))
