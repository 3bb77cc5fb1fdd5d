"""SentencePiece encoding and decoding: the segmentation of the largest total score.

A text gets a leading space, spaces become U+2581, and of all ways to cut it into pieces of the
vocabulary the one with the largest sum of scores is taken (the unigram rule; a character that
starts no piece is written as its bytes, at the least score minus 10). No piece has U+2581 after
another character, so paths always break where a space follows one, and each distinct word is
solved once, all words of a batch together in numpy. Scores of the given file are whole numbers, so sums are exact in any order.

Giant texts are cut into chunks that Spark deals to tasks. Each yields a max-plus matrix: the best
score from each of the last L positions before it to each of its own last L positions, L being the
longest piece. The matrices of a text are combined associatively to the state at every border. From it each chunk tells
where a path to each of its ends enters it; these maps, chained from the last chunk on, fix where the best path
crosses every border, and each chunk is then traced back on its own.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblore.llm import fingerprints as fp
from joblore.llm.scratch import arrow_function, free_name, short_batches, stash, with_fields

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts of more characters are cut into chunks of so many.
GIANT, CHUNK = 1 << 16, 1 << 14
#: Longer stretches where pieces overlap everywhere are gone through in grains of so many characters that advance together.
GRAIN, LONG = 128, 256
NONE = -np.inf


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = struct.unpack("<d" if size == 8 else "<f", data[at : at + size])[0], at + size
        yield key >> 3, value


class Vocabulary:
    """Pieces, scores and kinds of a SentencePiece model file (1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte)."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: dict[str, tuple[float, int]] = {}
        self.byte_ids, kinds = {}, []
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                piece, score, kind = own[1].decode(), float(own.get(2, 0.0)), own.get(3, 1)
                kinds.append(kind)
                if kind in (1, 4):
                    self.scores[piece] = (score, len(self.pieces))
                elif kind == 6:
                    self.byte_ids[int(piece[3:5], 16)] = len(self.pieces)
                elif kind == 2:
                    self.unknown = len(self.pieces)
                self.pieces.append(piece)
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece has a space after another character; words wouldn't be independent")
        self.longest = max(map(len, self.scores))
        self.unknown_score = min(s for s, _ in self.scores.values()) - 10
        self._grow()
        self.id_byte = {v: k for k, v in self.byte_ids.items()}
        self.byte_table = np.array([self.byte_ids.get(b, self.unknown) for b in range(256)], np.int32)
        self.silent = {i for i, k in enumerate(kinds) if k in (2, 3, 5)}

    def _grow(self) -> None:
        """The trie of all pieces. Nodes are numbers; edges (node, character) lie in a hash table of
        linear probing; gain and number are a node's piece's, gain -inf where no piece ends."""
        edges: dict[tuple[int, int], int] = {}
        gain, number = [NONE], [-1]
        for piece, (score, own) in self.scores.items():
            node = 0
            for c in map(ord, piece):
                after = edges.setdefault((node, c), len(gain))
                if after == len(gain):
                    gain.append(NONE)
                    number.append(-1)
                node = after
            gain[node], number[node] = score, own
        self.gain, self.number = np.array(gain), np.array(number, np.int32)
        keys = np.array([(n << 21 | c) + 1 for n, c in edges], np.uint64)
        self.shift = np.uint64(64 - (4 * len(keys)).bit_length())
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        at = np.arange(len(keys))
        place = np.maximum.accumulate(slot[order] - at) + at
        self.keys, self.next = np.zeros(int(place[-1]) + 2 + (1 << 64 - int(self.shift)), np.uint64), np.full(int(place[-1]) + 2 + (1 << 64 - int(self.shift)), -1, np.int32)
        self.keys[place], self.next[place] = keys[order], np.array(list(edges.values()), np.int32)[order]
        self.leaf = ~np.isin(np.arange(len(gain)), [n for n, _ in edges])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes that follow on the given characters, -1 where none does."""
        keys = (node.astype(np.uint64) << np.uint64(21) | chars.astype(np.uint64)) + np.uint64(1)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.next[slot], np.int32(-1))
        again = np.flatnonzero((found != keys) & (found != 0))
        while len(again):
            slot[again] += 1
            found = self.keys[slot[again]]
            hit = found == keys[again]
            out[again[hit]] = self.next[slot[again[hit]]]
            again = again[~hit & (found != 0)]
        return out

    def best(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best paths of many words: their ids, how many each has, and their scores.

        data: the words' UTF-8 bytes, spaces included, offs: their n + 1 bounds. Long words are cut where no
        piece crosses, longer stretches at the pieces that grains give. All words then advance together, by the place where a piece ends; of
        ties the longest last piece is taken.
        """
        first = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        chars[chars == 0x20] = ord(SPACE)
        bounds = np.searchsorted(first, offs)
        whole = len(offs) - 1
        cuts = crossed(self, chars, bounds)
        parts = 1 + np.bincount(np.searchsorted(bounds, cuts, "right") - 1, minlength=whole)
        offs, bounds = np.sort(np.append(offs, first[cuts])), np.sort(np.append(bounds, cuts))
        words, n = len(offs) - 1, len(chars)
        who = fp.owners(bounds)
        left = bounds[1:][who] - np.arange(n)  # characters to the word's end
        place = np.arange(n) - bounds[:-1][who]
        # The pieces of each length that begin at each character, by the place in the word where they end.
        found: list[tuple] = []
        at, node = np.arange(n), np.zeros(n, np.int32)
        while len(at):
            depth = len(found) + 1
            node = self.step(node, chars[at + (depth - 1)])
            gain = np.where(node >= 0, self.gain[node], NONE)
            number = self.number[node]
            if depth == 1:
                number = np.where(gain > NONE, number, np.int32(-1))
                gain[gain == NONE] = self.unknown_score
            some = np.flatnonzero(gain > NONE)
            end = place[at[some]] + depth
            order = np.argsort(end.astype(np.uint16) if n < 1 << 16 or int(end.max(initial=0)) < 1 << 16 else end, kind="stable")
            some = some[order]
            found.append((at[some] + who[at[some]], gain[some], number[some], np.append(0, np.cumsum(np.bincount(end, minlength=depth)))))
            alive = (node >= 0) & (left[at] > depth) & ~self.leaf[node]
            at, node = at[alive], node[alive]
        # A word has a node before each character and one at its end.
        score, back, piece = np.full(n + words, NONE), np.zeros(n + words, np.int32), np.zeros(n + words, np.int32)
        score[bounds[:-1] + np.arange(words)] = 0.0
        for end in range(1, int(place.max(initial=-1)) + 2):
            for depth in range(min(end, len(found)), 0, -1):
                start, gain, number, ends = found[depth - 1]
                x, y = (int(ends[min(e, len(ends) - 1)]) for e in (end, end + 1))
                if x < y:
                    value, to = score[start[x:y]] + gain[x:y], start[x:y] + depth
                    better = np.flatnonzero(value > score[to])
                    to = to[better]
                    score[to], back[to], piece[to] = value[better], depth, number[x:y][better]
        at, begin, path = bounds[1:] + np.arange(words), bounds[:-1] + np.arange(words), [np.zeros(0, np.int64)]
        total = score[at]
        while len(at):
            alive = at > begin
            at, begin = at[alive], begin[alive]
            path.append(at)
            at = at - back[at]
        path = np.sort(np.concatenate(path))
        owner = np.searchsorted(bounds[1:] + np.arange(words), path)
        ids = piece[path]
        count = np.ones(len(ids), np.int64)
        lone = np.flatnonzero(ids < 0)  # characters that start no piece are written as their bytes
        if len(lone):
            char = path[lone] - owner[lone] - 1
            of_char = np.where(chars[char] == ord(SPACE), 0, first[char])
            size = np.diff(np.append(first, len(data)))[char]
            count[lone] = size
            raw = data[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(of_char, size)]
            out = np.repeat(ids, count)
            out[np.repeat(ids < 0, count)] = self.byte_table[raw]
            ids = out
        of = np.repeat(np.arange(whole), parts)
        return ids, np.bincount(of[owner], count, minlength=whole).astype(np.int64), np.bincount(of, total, minlength=whole)

    def decode(self, ids: list[int]) -> str:
        out, first = bytearray(), True
        for i in ids:
            if i in self.id_byte:
                out.append(self.id_byte[i])
            elif i not in self.silent:
                piece = self.pieces[i].replace(SPACE, " ")
                out += piece.encode()
        text = out.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def normal(text: str) -> str:
    return (SPACE + text).replace(" ", SPACE) if text else ""


BORDER = re.compile(f"[^{SPACE}]{SPACE}")


def borders(text: str) -> list[int]:
    """Where a space follows another character: no piece crosses these places."""
    return [m.end() - 1 for m in BORDER.finditer(text)]


def _word_column(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null and empty: none), each with its leading spaces, and n + 1 bounds."""
    data, offs = fp.flat(column)
    size = np.diff(offs)
    has = size > 0
    # One more space leads each text.
    lead = np.cumsum(np.append(0, has.astype(np.int64)))
    moved = np.full(len(data) + int(has.sum()), 0x20, np.uint8)
    moved[np.arange(len(data)) + np.repeat(lead[1:], size)] = data
    offs = offs + lead
    space = moved == 0x20
    cut = np.zeros(len(moved) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    cut[offs] = True
    start = np.flatnonzero(cut[:-1])
    ends = np.append(start, len(moved))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(moved)])
    return words, np.searchsorted(start, offs)


def _short(told, text_col: str):
    """A function from texts to ids and score of each, by their distinct words."""

    def run(column: pa.Array) -> pa.Array:
        v, out = vocabulary(told.value), []
        table = pa.RecordBatch.from_arrays([column], [text_col])
        for batch in fp.pieces(iter([table]), text_col, 1 << 20):
            words, bounds = _word_column(batch.column(text_col))
            coded = words.dictionary_encode()
            flat, length, score = v.best(*fp.flat(coded.dictionary))
            index = coded.indices.to_numpy()
            first, n = np.cumsum(length) - length, length[index]
            ends = np.append(0, np.cumsum(n))
            at = np.arange(ends[-1]) - np.repeat(ends[:-1] - first[index], n)
            total = np.append(0, np.cumsum(score[index]))
            ids = fp.lists(flat[at], np.diff(ends[bounds]), pa.int32())
            out.append(pa.StructArray.from_arrays([ids, pa.array(total[bounds[1:]] - total[bounds[:-1]])], ["ids", "score"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("score", pa.float64())]))

    return run


def _cut(chunk: int, longest: int):
    """mapInArrow: a giant text's chunks of normal form, each with the L - 1 characters before it.

    A chunk begins where a space follows another character, if there is such a place within its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = normal(text)
                starts = [0]
                while (at := starts[-1] + chunk) < len(text):
                    space = BORDER.search(text, at, at + chunk)
                    starts.append(space.end() - 1 if space else at)
                for number, at in enumerate(starts):
                    end = starts[number + 1] if number + 1 < len(starts) else len(text)
                    left = max(0, at - longest + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([number], pa.int32()), pa.array([at - left], pa.int32()), pa.array([number + 1 == len(starts)]), pa.array([text[left:end]])],
                        ["row", "number", "left", "last", "text"],
                    )

    return run


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def walk(v: Vocabulary, chars: np.ndarray, at: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By length: the places of at where a piece of that length begins, and its score. end: where a place's word ends."""
    node, depth = np.zeros(len(at), np.int32), 0
    while len(at):
        depth += 1
        node = v.step(node, chars[at + depth - 1])
        gain = np.where(node >= 0, v.gain[node], NONE)
        if depth == 1:
            gain[gain == NONE] = v.unknown_score
        yield depth, at[gain > NONE], gain[gain > NONE]
        alive = (node >= 0) & ~v.leaf[node] & (at + depth < end[at])
        at, node = at[alive], node[alive]


def gains(v: Vocabulary, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[d - 1, p]: the score of the piece of d characters that ends before place p, inside a word."""
    out, depth = np.full((v.longest, len(chars) + 1), NONE), 1
    for depth, at, gain in walk(v, chars, np.arange(len(chars)), np.repeat(bounds[1:], np.diff(bounds))):
        out[depth - 1, at + depth] = gain
    return out[:depth]


def breaks(v: Vocabulary, chars: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places between characters that no piece from one of the places of at crosses. Borders before spaces are among them."""
    reach = np.arange(1, len(chars) + 1)
    for depth, own, _ in walk(v, chars, at, end):
        reach[own] = own + depth
    return np.flatnonzero(np.maximum.accumulate(reach)[:-1] == np.arange(1, len(chars))) + 1


def _steps(v: Vocabulary, gain: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """All grains go on by one character: the row of that place, the first row that a piece reaches back to,
    and the gains of the pieces that end there, the longest first. Row L - 1 is a grain's begin."""
    turned = gain[::-1]
    for step in range(1, int((end - begin).max(initial=0)) + 1):
        row = v.longest - 1 + step
        yield row, row - len(turned), turned[:, np.minimum(begin + step, end)]


def matrices(v: Vocabulary, gain: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[grain, j, i]: the best score from place begin - j to place end - i, by pieces that end after begin."""
    size, width, each = v.longest, int((end - begin).max(initial=0)), np.arange(len(begin))[:, None]
    score = np.full((size + width, size, len(begin)), NONE)
    for j in range(size):
        score[size - 1 - j, j] = 0.0
    for row, low, own in _steps(v, gain, begin, end):
        (score[low:row] + own[:, None, :]).max(axis=0, out=score[row])
    return score[size - 1 + (end - begin)[:, None] - np.arange(size), :, each].transpose(0, 2, 1)


def ways(v: Vocabulary, gain: np.ndarray, begin: np.ndarray, end: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[grain, i]: how far before the grain's begin the best path to end - i has its last place up to there.
    [row, grain]: the length of the last piece of the best path to a place; rows are those of _steps."""
    size, width, each = v.longest, int((end - begin).max(initial=0)), np.arange(len(begin))
    score = np.full((size + width, len(begin)), NONE)
    origin, last = np.zeros(score.shape, np.int32), np.zeros(score.shape, np.int32)
    score[size - 1 :: -1][:size], origin[size - 1 :: -1][:size] = states.T, np.arange(size)[:, None]
    for row, low, own in _steps(v, gain, begin, end):
        value = score[low:row] + own
        pick = value.argmax(axis=0)  # of ties the longest
        score[row], origin[row], last[row] = value[pick, each], origin[low + pick, each], row - low - pick
    return origin[size - 1 + (end - begin)[:, None] - np.arange(size), each[:, None]], last


def _states(v: Vocabulary, parts: np.ndarray, first: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state before each grain; where first holds it is the given one."""
    out = np.empty((len(parts), v.longest))
    for i, own in enumerate(parts):
        out[i] = now = state if first[i] else now
        now = (now[:, None] + own).max(axis=0)
    return out


def _start(v: Vocabulary) -> np.ndarray:
    state = np.full(v.longest, NONE)
    state[0] = 0.0
    return state


def crossed(v: Vocabulary, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places inside the words of over LONG characters that their best paths don't cross, so that few long stretches stay."""
    size = np.diff(bounds)
    inside = np.repeat(size > LONG, size)
    if not inside.any():
        return np.zeros(0, np.int64)
    place = breaks(v, chars, np.flatnonzero(inside), np.repeat(bounds[1:], size))
    place = np.setdiff1d(place[inside[place - 1] & inside[place]], bounds)
    return np.append(place, _by_grains(v, chars, np.sort(np.append(bounds, place))))


def _by_grains(v: Vocabulary, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The places inside the words of over LONG characters where their best paths have borders of pieces.

    Grains are traced back at once, each from where the path enters the next one."""
    size, out = np.diff(bounds), [np.zeros(0, np.int64)]
    long = np.flatnonzero(size > LONG)
    group = np.cumsum(size[long]) // GIANT  # so that the arrays hold about GIANT characters, or one word
    for words in np.split(long, np.flatnonzero(np.diff(group)) + 1) if len(long) else ():
        own = np.concatenate([chars[bounds[w] : bounds[w + 1]] for w in words])
        ends = np.append(0, np.cumsum(size[words]))
        begin = np.concatenate([np.arange(x, y, GRAIN) for x, y in zip(ends[:-1], ends[1:], strict=True)])
        end, first = np.append(begin[1:], ends[-1]), np.isin(begin, ends)
        gain = gains(v, own, ends)
        maps, last = ways(v, gain, begin, end, _states(v, matrices(v, gain, begin, end), first, _start(v)))
        goal, at = end.copy(), 0
        for i in range(len(begin) - 1, -1, -1):
            goal[i] -= at
            at = 0 if first[i] else int(maps[i, at])
        grain, place = np.flatnonzero(goal > begin), goal[goal > begin]
        found = [goal[:0]]
        while len(place):
            found.append(place)
            place = place - last[v.longest - 1 + place - begin[grain], grain]
            grain, place = grain[place > begin[grain]], place[place > begin[grain]]
        place = np.setdiff1d(np.concatenate(found), ends)
        word = np.searchsorted(ends, place, "right") - 1
        out.append(place - ends[word] + bounds[words[word]])
    return np.concatenate(out)


def _region(v: Vocabulary, chars: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gains of one stretch of text, and the begins and ends of its grains from left on."""
    begin = np.arange(left, len(chars), GRAIN)
    return gains(v, chars, np.array([0, len(chars)])), begin, np.append(begin[1:], len(chars))


def _product(v: Vocabulary, chars: np.ndarray, left: int) -> np.ndarray:
    """The matrix of a stretch of text: its grains' matrices, combined two by two."""
    parts = matrices(v, *_region(v, chars, left))
    while len(parts) > 1:
        half = len(parts) // 2
        paired = np.concatenate([combine(a, b)[None] for a, b in zip(parts[0 : 2 * half : 2], parts[1 : 2 * half : 2], strict=True)])
        parts = np.concatenate([paired, parts[2 * half :]])
    return parts[0]


def solved(v: Vocabulary, text: str, cuts: np.ndarray) -> tuple[np.ndarray, float]:
    """Ids and score of the best path of a text of normal form, which has borders of pieces at the given places."""
    data = np.frombuffer(text.encode(), np.uint8)
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    ids, _, score = v.best(data, first[np.concatenate([[0], cuts, [len(text)]]).astype(np.int64)])
    return ids, float(score.sum())


def _shared(v: Vocabulary, text: str, left: int) -> np.ndarray:
    """Places after left that all paths of a text share: borders before spaces, or all of them where words are long."""
    chars = codes(text)
    space = chars == ord(SPACE)
    place = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    if np.diff(place, prepend=0, append=len(chars)).max() > LONG:
        place = breaks(v, chars, np.arange(len(chars)), np.full(len(chars), len(chars)))
    return place[place > left]


def transfer(v: Vocabulary, text: str, left: int) -> np.ndarray:
    """M[j, i]: the best score from position left - j to position len(text) - i, by pieces that end after left.

    All paths share the places that no piece crosses: between the first after left and the last that lies
    before all of the L last positions only the best score counts.
    """
    size, n = v.longest, len(text)
    cuts, chars = _shared(v, text, left), codes(text)
    cuts = cuts[cuts <= n - size]
    if len(cuts) and np.diff(cuts).max(initial=0) <= LONG:
        out = _product(v, chars[: cuts[0]], left)[:, :1] + solved(v, text[cuts[0] : cuts[-1]], cuts[1:-1] - cuts[0])[1] + _product(v, chars[cuts[-1] :], 0)[:1]
    else:
        out = _product(v, chars, left).copy()
    out[left + 1 :], out[:, max(0, n - left) :] = NONE, NONE
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, which is associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All products of the first 1, 2, ... matrices, in a logarithmic number of sweeps."""
    out, step = list(matrices), 1
    while step < len(out):
        out = out[:step] + [combine(out[i - step], out[i]) for i in range(step, len(out))]
        step *= 2
    return out


def entries(v: Vocabulary, text: str, left: int, state: np.ndarray) -> np.ndarray:
    """For each i < L the place where the best path to len(text) - i crosses the chunk's begin, as a distance before it.

    state: the best scores of the last L positions up to left. Of ties the longest last piece is taken
    everywhere, so paths are those of the text as a whole.
    """
    size, n = v.longest, len(text)
    shared = int(next(iter(_shared(v, text, left)), n))
    gain, begin, end = _region(v, codes(text[:shared]), left)
    first = np.arange(len(begin)) == 0
    maps, _ = ways(v, gain, begin, end, _states(v, matrices(v, gain, begin, end) if len(begin) > 1 else np.zeros((len(begin), size, size)), first, state))
    at = np.arange(size)
    for own in maps[::-1]:
        at = own[at]
    reach = np.arange(min(size, n - left))
    out = np.zeros(size, np.int32)
    out[reach] = at[np.maximum(0, reach - (n - shared))]
    return out


def crossings(maps: list[np.ndarray]) -> list[int]:
    """At each chunk's end, how far before it the best path has its last border of pieces. maps: entries() of the chunks."""
    out = [0]
    for own in reversed(maps[1:]):
        out.append(int(own[out[-1]]))
    return out[::-1]


def _matrices(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(told.value)
        for batch in batches:
            texts, lefts = batch.column("text").to_pylist(), batch.column("left").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("number"), pa.array([transfer(v, t, n).tobytes() for t, n in zip(texts, lefts, strict=True)], pa.binary())], ["row", "number", "matrix"]
            )

    return run


def _before(table: pa.Table) -> pa.Table:
    """Per giant text: the state before each chunk. 2 KB for each 16 K characters come together
    here, 0.3 GB for the largest text that a cell can hold."""
    table = table.sort_by("number")
    flat = [np.frombuffer(m) for m in table["matrix"].to_pylist()]
    size = int(len(flat[0]) ** 0.5)
    states = [m[0] for m in scan([m.reshape(size, size) for m in flat])]  # every path starts at position 0 of the text
    start = np.full(size, NONE)
    start[0] = 0.0
    return pa.table({"row": table["row"], "number": table["number"], "state": pa.array([s.tobytes() for s in [start, *states[:-1]]], pa.binary())})


def _entries(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(told.value)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "left", "state")), strict=True)
            maps = [entries(v, text, left, np.frombuffer(state)).tobytes() for text, left, state in rows]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("number"), pa.array(maps, pa.binary())], ["row", "number", "map"])

    return run


def _borders(table: pa.Table) -> pa.Table:
    """Per giant text: entry and exit of the best path in each chunk."""
    table = table.sort_by("number")
    exits = crossings([np.frombuffer(m, np.int32) for m in table["map"].to_pylist()])
    return pa.table({"row": table["row"], "number": table["number"], "entry": pa.array([0, *exits[:-1]], pa.int32()), "exit": pa.array(exits, pa.int32())})


def _trace(told):
    """mapInArrow: each chunk's part of the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(told.value)
        for batch in batches:
            out = []
            for text, left, entry, exit in zip(*(batch.column(c).to_pylist() for c in ("text", "left", "entry", "exit")), strict=True):
                text = text[left - entry : len(text) - exit]
                ids, score = solved(v, text, _shared(v, text, 0))
                out.append((score, ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("number"), pa.array([i for _, i in out], pa.list_(pa.int32())), pa.array([s for s, _ in out], pa.float64())], ["row", "number", "ids", "score"]
            )

    return run


def encode(docs: DataFrame, text_col: str = "text", path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """docs with ids (array<int>) and score of the best segmentation of each text.

    Null and empty texts have no ids and score 0. Of paths that tie, the longest last piece is taken, in
    texts that are cut into chunks as in others. Columns of docs named ids or score are replaced. The
    vocabulary (path, a file of the driver's, a few MB) is sent to the tasks. A vocabulary trained for merges gives
    other ids here than with the public library's default, which merges.
    """
    spark = docs.sparkSession
    short_batches(spark)
    model = model_bytes(path)
    longest, told = vocabulary(model).longest, spark.sparkContext.broadcast(model)
    if chunk < 2 * longest:
        raise ValueError(f"chunks must have at least {2 * longest} characters")
    docs = docs.drop("ids", "score")
    length = F.coalesce(F.char_length(text_col), F.lit(0))
    # Only the text goes to Python; the other columns wait in the JVM.
    short = arrow_function(_short(told, text_col), "struct<ids: array<int>, score: double>")
    s, row, of = (free_name(docs, c) for c in ("__s", "__row", "__of"))
    small = docs.filter(length <= giant).withColumn(s, short(F.col(text_col))).withColumns({"ids": F.col(s)["ids"], "score": F.col(s)["score"]}).drop(s)
    giants = stash(docs.filter(length > giant).withColumn(row, F.monotonically_increasing_id()), "giants")
    total = giants.agg(F.sum(F.char_length(text_col))).first()[0] or 0
    tasks = -(-total // (8 * chunk)) + 1  # given, as chunks are small: adaptive execution would put them all in one task
    chunks = giants.select(F.col(row).alias("row"), F.col(text_col).alias("text")).mapInArrow(_cut(chunk, longest), "row long, number int, left int, last boolean, text string")
    chunks = stash(chunks.repartition(tasks, "row", "number"), "chunks")
    states = chunks.mapInArrow(_matrices(told), "row long, number int, matrix binary").groupBy("row").applyInArrow(_before, "row long, number int, state binary")
    spread = lambda told_of: chunks.join(told_of, ["row", "number"]).repartition(tasks, "row", "number")
    ways = spread(states).mapInArrow(_entries(told), "row long, number int, map binary").groupBy("row").applyInArrow(_borders, "row long, number int, entry int, exit int")
    parts = spread(ways).mapInArrow(_trace(told), "row long, number int, ids array<int>, score double")
    large = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("number", "ids"))).alias("p"), F.sum("score").alias("score"))
    large = large.select("row", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), "score")
    return small.unionByName(giants.join(large.withColumnRenamed("row", of), F.col(row) == F.col(of)).drop(row, of))


def decode(docs: DataFrame, ids_col: str = "ids", path: str = MODEL, out_col: str = "decoded") -> DataFrame:
    """docs with the text of their ids in out_col; null ids give null, ids that are null or no piece's give
    nothing. It equals the text that was encoded, but that U+2581 comes back as a space."""
    told = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(told.value)
        table = [v.id_byte[i].to_bytes() if i in v.id_byte else b"" if i in v.silent else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)]
        length = np.array([*map(len, table), 0])
        first, data = np.cumsum(length) - length, np.frombuffer(b"".join(table), np.uint8)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                column = batch.column(batch.schema.get_field_index(ids_col))
                ids, count = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                ids = np.where((ids < 0) | (ids >= len(table)), len(table), ids)
                n = length[ids]
                ends = np.append(0, np.cumsum(n))
                out = data[np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(first[ids], n)].tobytes()
                bounds = ends[np.append(0, np.cumsum(count))]
                texts = [out[x:y].decode("utf-8", "replace") for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                texts = [None if null else t[1:] if t.startswith(" ") else t for t, null in zip(texts, column.is_null().to_pylist(), strict=True)]
                keep = [i for i, c in enumerate(batch.schema.names) if c != out_col]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())], [*(batch.schema.names[i] for i in keep), out_col])

    return docs.drop(out_col).mapInArrow(run, with_fields(docs.drop(out_col).schema, **{out_col: T.StringType()}))
