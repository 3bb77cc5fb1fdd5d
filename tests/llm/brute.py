"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import re
from collections import defaultdict

LOWER = {c: c + 32 for c in range(65, 91)}


def repeats(docs: list[tuple], length: int) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, kept) of distinct ids."""
    first: dict = {}
    data = {d: (t or "").encode() for d, t in docs}
    for d, b in data.items():
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, b in data.items():
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def leak_words(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def leaks(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_hit, item ids) of each row."""
    windows = defaultdict(set)
    for item, text in items:
        w = leak_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = leak_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def shingles(text, n: int) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(docs: list[tuple], n: int, num: int, den: int) -> dict:
    """doc_id -> (number of shingles, component)."""
    sets = {d: shingles(t, n) for d, t in docs}
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def longest_common(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        row = new
    return row[-1]
