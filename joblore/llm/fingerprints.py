"""Fingerprints of bytes and words of Arrow string columns, computed with numpy inside tasks.

A text is read as UTF-8. A fingerprint of a span takes its bytes eight at a time and mixes each into
64 bits; those of runs are made by prefix doubling: fingerprints at growing offsets are paired until the
run is covered. No step is linear, so neither repetitive nor self-similar texts collide by
construction. They depend on the content alone and agree between tasks, executors and runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: The bytes of a little-endian load that belong to a span of 0 to 8 more bytes.
_MASKS = np.array([(1 << 8 * b) - 1 for b in range(9)], dtype=U64)
#: Spans of more bytes are few and are hashed one by one.
LONG_SPAN = 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that holds for the bytes of the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Fingerprints of ordered pairs."""
    z = x * _ODD[0]
    z ^= z >> U64(31)
    z += y * _ODD[1]
    return mix(z)


def _salt(n: int, family: int) -> np.uint64:
    return U64((n * 0x2545F4914F6CDD1D + family * 0xA24BAED4963EE407 + 0x8F14E45FCEEA167A) & (1 << 64) - 1)


def _loads(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n places on, as unaligned 64-bit values (a view)."""
    return np.ndarray((n,), "<u8", data, strides=(1,))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """Fingerprints of the bytes of the spans [start, end), lengths included. Families are independent."""
    size = end - start
    out = mix(size.astype(U64) * _ODD[0] + _salt(0, family))
    loads = _loads(np.append(data, np.zeros(8, np.uint8)), len(data) + 1)
    long = size > LONG_SPAN
    for i in np.flatnonzero(long):
        own = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=bytes([family])).digest()
        out[i] = int.from_bytes(own, "little")
    at = np.flatnonzero(~long & (size > 0))
    start, size = start[at], size[at]
    while len(at):
        out[at] = paired(out[at], loads[start] & _MASKS[np.minimum(size, 8)])
        more = size > 8
        at, start, size = at[more], start[more] + 8, size[more] - 8
    return out


def _doubled(x: np.ndarray, width: int, k: int) -> np.ndarray:
    """From fingerprints of all runs of width those of all runs of k, paired at growing offsets."""
    while width < k:
        offset = min(width, k - width)
        x = paired(x[:-offset], x[offset:])
        width += offset
    return x


def grams(values: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Fingerprints of all runs of k consecutive 64-bit values, in order (none if there are fewer)."""
    if len(values) < k:
        return np.zeros(0, dtype=U64)
    return _doubled(mix(values + _salt(k, family)), 1, k)


def byte_grams(data: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Fingerprints of all runs of k consecutive bytes, in order (none if there are fewer)."""
    if len(data) < k:
        return np.zeros(0, dtype=U64)
    if k < 8:
        return grams(data.astype(U64), k, family)
    return _doubled(mix(_loads(data, len(data) - 7) + _salt(k, family)), 8, k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(x[i : i + w]), for the len(x) - w + 1 whole windows."""
    if len(x) < w:
        return x[:0]
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = w - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def places_of_minima(x: np.ndarray, w: int) -> np.ndarray:
    """For each of the len(x) - w + 1 windows of w values the place of the least one, of ties the first.

    Of a value the lower bits, seven or as many as count to 2 w, hold its place and aren't compared. Places
    are counted from two starts, and each window takes the count that doesn't begin anew within it.
    """
    if len(x) < w:
        return np.zeros(0, np.int64)
    half = U64(1 << max(6, (w - 1).bit_length()))
    low = U64(2) * half - U64(1)
    place, value = np.arange(len(x), dtype=U64), x & ~low
    near, far = (sliding_min(value | (place + shift & low), w) for shift in (U64(0), half))
    start = place[: len(near)]
    least = np.where(start & half, far - half, near)
    return (start + (least - start & low)).astype(np.int64)


def window_minima(x: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: marks the least x[p] of each valid window of w values (see places_of_minima).

    valid[i] says whether the window that starts at i counts; it has len(x) - w + 1 values.
    """
    marked = np.zeros(len(x), dtype=bool)
    marked[places_of_minima(x, w)[valid]] = True
    return marked


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about limit bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0))
        group = np.cumsum(length) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for first, last in zip(np.append(0, cuts), np.append(cuts, batch.num_rows), strict=True):
            yield batch.slice(first, last - first)


def words(data: np.ndarray, offs: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the n + 1 places where its words begin in them."""
    inside = word_bytes[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[offs] = False
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[offs] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return start, end, np.searchsorted(start, offs)


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each element the index of the text whose range in bounds holds it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of values, as many as counts says, as an Arrow list column."""
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, type=kind))
