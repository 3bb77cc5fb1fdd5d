"""License scan: chains of winnowed fingerprints pick candidates, banded alignment measures them.

Each template's runs of k words are winnowed: of w neighbouring hashes the least is kept. The kept
ones form an inverted index (hash to template and place). A hash that a text shares with a
template says on which diagonal (place in the text less place in the template) they may run along;
hits that grow in both are chained across diagonals, over insertions of up to the template's length
each and any deletions, to one candidate. It is aligned with the template inside a band that follows
the chain: matched words are counted by a longest common subsequence, and the candidate is reported
if enough of the template's words match.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblore.llm import fingerprints as fp
from joblore.llm.license_texts import TEMPLATES
from joblore.llm.scratch import short_batches

WORD = fp.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Pairs of hits that are compared at once.
PAIRS = 1 << 19
FOUND = "template string, coverage double, matched int, start int, end int, byte_start long, byte_end long"


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offs = fp.flat(column)
    data = fp.LOWER[data]
    start, end, bounds = fp.words(data, offs, WORD)
    return fp.spans(data, start, end), bounds, start, end, offs


class Index:
    """The templates' words and the inverted index of their winnowed runs of words.

    A template of fewer words than k + w - 1 keeps all of its runs; it must have k words.
    """

    def __init__(self, templates: dict[str, str], k: int = 3, w: int = 4):
        self.names, self.k, self.w = list(templates), k, w
        words, bounds, *_ = _hashes(pa.array(list(templates.values())))
        self.words = [words[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        keys, owner, place = [], [], []
        for i, own in enumerate(self.words):
            if len(own) < k:
                raise ValueError(f"template {self.names[i]!r} has under {k} words")
            runs = fp.grams(own, k)
            kept = np.flatnonzero(fp.window_minima(runs, np.ones(max(0, len(runs) - w + 1), bool), w)) if len(runs) >= w else np.arange(len(runs))
            keys.append(runs[kept])
            owner.append(np.full(len(kept), i))
            place.append(kept)
        keys, self.owner, self.place = (np.concatenate(x) for x in (keys, owner, place))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[order], self.owner[order], self.place[order]


def align(template: np.ndarray, text: np.ndarray, low: int | np.ndarray, high: int | np.ndarray) -> tuple[int, int, int]:
    """Of template words and text words with low <= text place - template place <= high (numbers, or
    one for each template word): the most that match in order, and the range [first, last + 1) of the
    text that the matches span.

    Of ties the match that begins last, then the one that ends first is taken.
    """
    n, m = len(text), len(template)
    first = np.clip(np.arange(m) + low, 0, n)
    last = np.maximum(first, np.clip(np.arange(m) + high + 1, 0, n))
    places: dict[int, int] = dict.fromkeys(template.tolist(), 0)
    for j, word in enumerate(text.tolist()):
        if word in places:
            places[word] |= 1 << j
    rows = [places[word] & (1 << y) - (1 << x) for word, x, y in zip(template.tolist(), first.tolist(), last.tolist(), strict=True)]

    def steps(rows: Iterable[int]) -> int:
        """The text places at which the longest common subsequence of the rows so far grows, as bits."""
        full = (1 << n) - 1
        kept = full
        for row in rows:
            kept = (kept + (kept & row) | kept & ~row) & full
        return kept ^ full

    turned = steps(int(f"{row:0{n}b}"[::-1], 2) if row else 0 for row in reversed(rows))
    if not turned:
        return 0, -1, 0
    start = n - turned.bit_length()
    return turned.bit_count(), start, steps(row >> start << start for row in rows).bit_length()


def _hits(index: Index, runs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(template, places in the text, places in the template) of the shared hashes of one text, by place in the text."""
    left, right = np.searchsorted(index.keys, runs, "left"), np.searchsorted(index.keys, runs, "right")
    count = right - left
    at = np.repeat(np.arange(len(runs)), count)
    entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
    template, place = index.owner[entry], index.place[entry]
    order = np.lexsort((place, at, template))
    template, at, place = template[order], at[order], place[order]
    cut = np.flatnonzero(np.diff(template)) + 1
    for x, y in zip(np.append(0, cut), np.append(cut, len(template)), strict=True):
        if y > x:
            yield int(template[x]), at[x:y], place[x:y]


def _chains(at: np.ndarray, place: np.ndarray, size: int, step: int, loss: float) -> list[np.ndarray]:
    """Chains of hits that grow in text and template, the best first, so that each hit is in one or more.

    Between neighbours of a chain the text has at most size words more than the template. A chain is
    worth its words, a hit counting up to step of them, less loss for each word more in the text.
    """
    worth, before = np.full(len(at), float(step)), np.full(len(at), -1)
    left = np.searchsorted(at, at - 2 * size, "left")
    # Hits of one place in the template can't follow each other, so they are taken together, by place.
    order = np.argsort(place, kind="stable")
    pairs = np.cumsum(order - left[order]) // PAIRS
    for own in np.split(order, np.flatnonzero(np.diff(place[order]) | np.diff(pairs)) + 1):
        count = own - left[own]
        of = np.repeat(np.arange(len(own)), count)
        other = np.arange(len(of)) - np.repeat(np.cumsum(count) - count - left[own], count)
        down, along = place[own][of] - place[other], at[own][of] - at[other]
        more = along - down
        good = (down > 0) & (along > 0) & (more <= size)
        of, other, down, along, more = (x[good] for x in (of, other, down, along, more))
        value = worth[other] + np.minimum(np.minimum(down, along), step) - np.where(more > 0, loss * more, -1e-6 * more)
        top, last = np.full(len(own), -1.0), np.full(len(own), -1)
        np.maximum.at(top, of, value)
        tied = value == top[of]
        np.maximum.at(last, of[tied], other[tied])
        better = top > worth[own]
        worth[own[better]], before[own[better]] = top[better], last[better]
    out, seen = [], np.zeros(len(at), bool)
    for i in np.argsort(-worth, kind="stable").tolist():
        if not seen[i]:
            chain = [i]
            while before[chain[-1]] >= 0:
                chain.append(int(before[chain[-1]]))
            seen[chain] = True
            out.append(np.array(chain[::-1]))
    return out


def _most(own: np.ndarray, words: np.ndarray) -> int:
    """How many words of a template can match at most: those that the text has anywhere."""
    return int(np.isin(own, words).sum())


def _measure(own: np.ndarray, words: np.ndarray, at: np.ndarray, place: np.ndarray, band: int, coverage: float) -> tuple[int, int, int]:
    """Matched words and span of the template `own` along one chain; none where too few of its words are there.

    A template word may stand on the diagonals of the hits before and after it, between them, and band beside them.
    """
    diagonal, row = at - place, np.arange(len(own))
    before = diagonal[np.maximum(np.searchsorted(place, row, "right") - 1, 0)]
    after = diagonal[np.minimum(np.searchsorted(place, row, "left"), len(place) - 1)]
    low, high = np.minimum(before, after) - band, np.maximum(before, after) + band
    first, last = max(0, int(low[0])), min(len(words), int(high[-1]) + len(own))
    if _most(own, words[first:last]) < coverage * len(own):
        return 0, 0, 0
    matched, start, end = align(own, words[first:last], low - first, high - first)
    return matched, first + start, first + end


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (matched, start, end) that overlap, the one of the most matched words, then the earliest; by start."""
    kept: list[tuple[int, int, int]] = []
    for x in sorted(set(found), key=lambda x: (-x[0], x[1], x[2])):
        i = bisect_left(kept, x[1], key=lambda y: y[1])
        if (not i or kept[i - 1][2] <= x[1]) and (i == len(kept) or x[2] <= kept[i][1]):
            kept.insert(i, x)
    return kept


def matches(index: Index, words: np.ndarray, runs: np.ndarray, band: int, coverage: float) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matched words, first word, last word + 1) of one text.

    Of candidates of a template whose spans overlap, the one of the largest coverage, then the earliest,
    stays. The words between those that stay are searched again, until they hold no more.
    """
    out = []
    for template, at, place in _hits(index, runs):
        own = index.words[template]
        parts = [(0, len(words))]
        while parts:
            low, high = parts.pop()
            if _most(own, words[low:high]) < coverage * len(own):
                continue
            x, y = np.searchsorted(at, low), np.searchsorted(at, high - index.k, "right")
            found = []
            # The first loss leaves copies apart that are whole enough, the second joins what one copy can hold.
            for loss in (1 - coverage, 1e-6) if x < y else ():
                for chain in _chains(at[x:y], place[x:y], len(own), max(index.k, index.w), loss):
                    matched, start, end = _measure(own, words[low:high], at[x:y][chain] - low, place[x:y][chain], band, coverage)
                    if matched >= coverage * len(own):
                        found.append((matched, low + start, low + end))
                if found:
                    break
            kept = _apart(found)
            out += [(template, matched / len(own), matched, start, end) for matched, start, end in kept]
            if kept:
                parts += zip([low, *(end for *_, end in kept)], [*(start for _, start, _ in kept), high], strict=True)
    return sorted(out, key=lambda x: (x[3], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = 3, w: int = 4, band: int = 8, coverage: float = 0.8) -> DataFrame:
    """Per row of docs: doc_id and `matches`, an array of FOUND: template, coverage (share of the
    template's words that match in order), matched words, their span in words and in bytes of the text.

    Null, empty and clean texts have an empty array. Templates are a parameter of the job and few
    (their index is sent to every task); each must have k words. Words count as matched on or between
    the diagonals of kept runs of k words and up to band beside them; any w + k - 1 equal words in a
    row hold a kept run. Between two runs at most a template's length of words may be inserted. Each
    template is looked for alone, so the same words may match several; rows that repeat an id are scanned
    one by one. Matches are sorted by start, then template. A task holds one whole text at least.
    """
    short_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, k, w))
    entry = pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = told.value
        for batch in fp.pieces(batches, "text"):
            words, bounds, start, end, offs = _hashes(batch.column("text"))
            runs = fp.grams(words, k)
            place = np.minimum(np.searchsorted(index.keys, runs), len(index.keys) - 1)
            hit = np.zeros(len(words) + 1, np.int64)
            hit[1 : len(runs) + 1] = np.cumsum(index.keys[place] == runs)
            hit[len(runs) + 1 :] = hit[len(runs)]
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(hit[np.maximum(bounds[:-1], bounds[1:] - k + 1)] > hit[bounds[:-1]]):
                x, y = bounds[i], bounds[i + 1]
                for template, share, matched, first, last in matches(index, words[x:y], runs[x : max(x, y - k + 1)], band, coverage):
                    out[i].append((index.names[template], share, matched, first, last, int(start[x + first] - offs[i]), int(end[x + last - 1] - offs[i])))
            rows = [[dict(zip(("template", "coverage", "matched", "start", "end", "byte_start", "byte_end"), m, strict=True)) for m in own] for own in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(entry))], ["doc_id", "matches"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = FOUND.replace(" string", ": string").replace(" double", ": double").replace(" int", ": int").replace(" long", ": long")
    return rows.mapInArrow(run, f"doc_id {kind}, matches array<struct<{fields}>>")
