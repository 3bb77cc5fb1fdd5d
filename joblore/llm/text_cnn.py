"""Toxicity classifier: a convolutional network over hashed words, trained and applied with numpy.

A word's vector is the sum of hashed embeddings of the word and of its first 3 to 6 bytes. Filters over
1, 2 and 3 neighbouring words are max-pooled over the whole text into a logistic output. A cut-off is
calibrated for each language, which is told from the function words of the text itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblore.llm import fingerprints as fp
from joblore.llm.labels import remainder, training_rows
from joblore.llm.scratch import arrow_function, short_batches

#: Labelled texts of each class that are fitted, at most, and bytes of all of them, which the driver holds.
PER_CLASS, MOST_BYTES = 2000, 64 << 20
WORD = fp.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
PREFIXES = (3, 4, 5, 6)
#: Function words that tell a language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with are was this",
    "de": "der die und das ist nicht ein eine zu den mit von sich",
    "fr": "le la les des et est une du que pas dans pour sur au",
    "es": "el los las de que en un por con para una del se",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1


def _hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return fp.spans(data, np.array([0]), np.array([len(data)]))[0]


def _function_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((int(_hash(w)), i) for i, words in enumerate(FUNCTION_WORDS.values()) for w in words.split())
    return np.array([h for h, _ in pairs], fp.U64), np.array([i for _, i in pairs])


_FUNCTION_HASHES, _FUNCTION_LANGUAGES = _function_table()


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers (tokens by 1 + prefixes; 0 is none), n + 1 bounds of the texts in them, and languages.

    PAD empty tokens follow each text, so that filters that begin in it don't reach the next one.
    """
    data, offs = fp.flat(column)
    data = fp.LOWER[data]
    start, end, bounds = fp.words(data, offs, WORD)
    n = len(offs) - 1
    who = fp.owners(bounds)
    whole = fp.spans(data, start, end)
    out = np.zeros((len(start) + PAD * n, 1 + len(PREFIXES)), np.int32)
    at = np.arange(len(start)) + PAD * who
    out[at, 0] = (whole % fp.U64(buckets - 1)).astype(np.int32) + 1
    for i, size in enumerate(PREFIXES, 1):
        long = np.flatnonzero(end - start > size)
        prefix = fp.spans(data, start[long], start[long] + size, i)
        out[at[long], i] = (prefix % fp.U64(buckets - 1)).astype(np.int32) + 1
    place = np.minimum(np.searchsorted(_FUNCTION_HASHES, whole), len(_FUNCTION_HASHES) - 1)
    known = np.flatnonzero(_FUNCTION_HASHES[place] == whole)
    votes = np.zeros((n, len(LANGUAGES)))
    # A word of two languages stands beside itself in the table; the first entry votes.
    np.add.at(votes, (who[known], _FUNCTION_LANGUAGES[place[known]]), 1)
    votes[:, -1] = 0.5
    return out, bounds + PAD * np.arange(n + 1), votes.argmax(axis=1)


@dataclass
class TextCnn:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: width x dim x filters
    biases: list[np.ndarray]
    weight: np.ndarray
    bias: float
    cutoffs: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def convolve(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors, and the filters' outputs where they begin (tokens by filters).

        ends: where texts end. Filters that begin in the empty tokens before count 0.
        """
        e = self.embedding[tokens[:, 0]]
        for i in range(1, tokens.shape[1]):
            e += self.embedding[tokens[:, i]]
        outs = []
        for k, b in zip(self.filters, self.biases, strict=True):
            z = e @ k[0] + b
            for i in range(1, len(k)):
                z[:-i] += e[i:] @ k[i]
            outs.append(np.maximum(z, 0, out=z))
        out = np.concatenate(outs, axis=1)
        for i in range(1, PAD + 1):
            out[ends - i] = 0
        return e, out

    def logits(self, tokens: np.ndarray, bounds: np.ndarray, texts: int = 256) -> np.ndarray:
        out = [np.zeros(0)]
        for first in range(0, len(bounds) - 1, texts):
            own = bounds[first : first + texts + 1]
            pooled = np.maximum.reduceat(self.convolve(tokens[own[0] : own[-1]], own[1:] - own[0])[1], own[:-1] - own[0], axis=0)
            out.append(pooled @ self.weight + self.bias)
        return np.concatenate(out)

    def scores(self, column: pa.Array) -> np.ndarray:
        tokens, bounds, language = features(column, len(self.embedding))
        return 1 / (1 + np.exp(-np.clip(self.logits(tokens, bounds) - self.cutoffs[language], -30, 30)))


def _take(tokens: np.ndarray, bounds: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(bounds)[some]
    ends = np.append(0, np.cumsum(count))
    return tokens[np.arange(ends[-1]) - np.repeat(ends[:-1], count) + np.repeat(bounds[:-1][some], count)], ends


def _initial(tokens: np.ndarray, bounds: np.ndarray, y: np.ndarray, buckets: int, dim: int, filters: int, random: np.random.Generator) -> TextCnn:
    """Random weights, but that the first coordinate of a bucket says how much more toxic texts it is in."""
    inside = [np.zeros(buckets), np.zeros(buckets)]
    for first in range(0, len(y), 64):
        some = np.arange(first, min(len(y), first + 64))
        own, ends = _take(tokens, bounds, some)
        pairs = np.unique((fp.owners(ends).astype(np.int64)[:, None] * buckets + own).ravel())
        toxic = y[first + pairs // buckets] == 1
        inside[1] += np.bincount(pairs[toxic] % buckets, minlength=buckets)
        inside[0] += np.bincount(pairs[~toxic] % buckets, minlength=buckets)
    odds = np.log((inside[1] + 1.0) / (y.sum() + 2)) - np.log((inside[0] + 1.0) / ((1 - y).sum() + 2))
    odds *= (inside[0] + inside[1]) / (inside[0] + inside[1] + 4.0)
    embedding = random.normal(0, 0.05, (buckets, dim)).astype(np.float32)
    embedding[:, 0] = np.clip(odds, -3, 3)
    embedding[0] = 0
    kernels = [random.normal(0, 0.1, (w, dim, filters)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[0, 0, : filters // 2] = np.linspace(0.5, 1.0, filters // 2)
    return TextCnn(embedding, kernels, [np.full(filters, -0.5, np.float32) for _ in WIDTHS], np.full(filters * len(WIDTHS), 0.1, np.float32), -1.0)


def fit(column: pa.Array, y: np.ndarray, buckets: int = 1 << 16, dim: int = 12, filters: int = 8, epochs: int = 4, rate: float = 0.01, batch: int = 64, least_steps: int = 120, seed: int = 3, weight: np.ndarray | None = None) -> TextCnn:
    """A model of labels y of whole texts, of row weights of mean 1 (all 1 if none are given). A fifth of them is left out of the gradient steps and
    calibrates the cut-offs, together with the rest. Few texts are gone through more often, for
    least_steps steps at least."""
    random = np.random.default_rng(seed)
    weight = np.ones(len(y)) if weight is None else weight
    small = np.uint16 if buckets <= 1 << 16 else np.int32  # all tokens of all texts are held
    parts_of = [(t.astype(small), b, v) for t, b, v in (features(column.slice(i, 256), buckets) for i in range(0, max(1, len(y)), 256))]
    tokens, language = (np.concatenate([p[i] for p in parts_of]) for i in (0, 2))
    bounds = np.append(0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts_of])))
    del parts_of
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        model = _initial(tokens, bounds, y, buckets, dim, filters, random) if len(y) else TextCnn(np.zeros((buckets, dim), np.float32), [np.zeros((w, dim, filters), np.float32) for w in WIDTHS], [np.zeros(filters, np.float32)] * 3, np.zeros(filters * 3, np.float32), 0.0)
        model.weight[:], model.bias = 0, float(np.log(share / (1 - share)))
        return model
    fitted = np.flatnonzero(random.random(len(y)) < 0.8)
    if len({*y[fitted]}) < 2:
        fitted = np.arange(len(y))
    model = _initial(*_take(tokens, bounds, fitted), y[fitted], buckets, dim, filters, random)
    parts = [*model.filters, *model.biases, model.weight, np.array([model.bias], np.float32)]
    first, second = ([np.zeros_like(p) for p in parts] for _ in range(2))
    squares, step = np.zeros(buckets, np.float32), 0
    for _ in range(max(epochs, -(-least_steps * batch // len(fitted)))):
        order = random.permutation(fitted)
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            own, ends = _take(tokens, bounds, some)
            e, z = model.convolve(own, ends[1:])
            pooled = np.maximum.reduceat(z, ends[:-1], axis=0)
            who = fp.owners(ends)
            place = np.where(z == pooled[who], np.arange(len(z), dtype=np.int32)[:, None], np.int32(1 << 30))
            place = np.minimum.reduceat(place, ends[:-1], axis=0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.weight + parts[-1][0], -30, 30)))
            error = (weight[some] * (p - y[some]) / len(some)).astype(np.float32)
            back = error[:, None] * model.weight * (pooled > 0)
            grads, grad_e, column_at = [], np.zeros_like(e), 0
            for k in model.filters:
                at, g = place[:, column_at : column_at + filters], back[:, column_at : column_at + filters]
                column_at += filters
                grad = np.zeros_like(k)
                for i in range(len(k)):
                    to = np.minimum(at + i, len(e) - 1)
                    grad[i] = np.einsum("nfd,nf->df", e[to], g)
                    np.add.at(grad_e, to, g[:, :, None] * k[i].T[None])
                grads.append(grad)
            column_at = 0
            for _k in model.filters:
                grads.append(back[:, column_at : column_at + filters].sum(axis=0))
                column_at += filters
            grads += [pooled.T @ error, np.array([error.sum()], np.float32)]
            step += 1
            for i, (part, g) in enumerate(zip(parts, grads, strict=True)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                part -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-6)
            touched = np.flatnonzero(np.abs(grad_e).sum(axis=1))
            for i in range(own.shape[1]):
                rows, g = own[touched, i], grad_e[touched]
                np.add.at(squares, rows, (g * g).mean(axis=1))
                np.subtract.at(model.embedding, rows, 0.1 * rate * g / (np.sqrt(squares[rows]) + 1e-4)[:, None])
            model.embedding[0] = 0
    model.bias = float(parts[-1][0])
    _calibrate(model, model.logits(tokens, bounds), y, language, weight, np.isin(np.arange(len(y)), fitted))
    return model


def _cutoff(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap that leaves the least weight on the wrong side."""
    order = np.argsort(logit)
    logit, y, weight = logit[order], y[order], weight[order]
    wrong = np.append(0, np.cumsum(weight * y)) + np.append(np.cumsum((weight * (1 - y))[::-1])[::-1], 0)
    edges = np.concatenate([[logit[0] - 1], (logit[1:] + logit[:-1]) / 2, [logit[-1] + 1]])
    wide = np.concatenate([[1.0], np.diff(logit), [1.0]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9 * weight.sum())
    return float(edges[best[np.argmax(wide[best])]])


def _calibrate(model: TextCnn, logit: np.ndarray, y: np.ndarray, language: np.ndarray, weight: np.ndarray, fitted: np.ndarray, least: int = 20) -> None:
    """One cut-off for each language with enough texts of both classes, the common one for the rest."""
    weight = weight * np.where(fitted, 1.0, 4.0)  # texts that took no gradient step say more
    model.cutoffs[:] = _cutoff(logit, y, weight)
    for i in range(len(LANGUAGES)):
        own = language == i
        if min(y[own].sum(), (1 - y[own]).sum()) >= least:
            model.cutoffs[i] = _cutoff(logit[own], y[own], weight[own])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held_out: int = 0, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> TextCnn:
    """A model of `label` from whole texts of at most per_class labelled documents of each class, and of at
    most most_bytes, which weigh as much as all labelled documents of their class."""
    table = training_rows(docs, labels, label, parts, held_out, per_class, id_col, text_col, most_bytes).toArrow().sort_by("doc_id")
    weight = table["weight"].to_numpy().astype(np.float64)
    texts = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
    return fit(texts, table["label"].to_numpy().astype(np.float64), weight=weight / weight.mean() if table.num_rows else weight)


def with_toxicity(docs: DataFrame, model: TextCnn, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each whole text in score_col (an existing column of that name is replaced)."""
    short_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        table = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [told.value.scores(b.column("text")) for b in fp.pieces(iter([table]), "text", 1 << 19)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    # Only the text goes to Python; the other columns wait in the JVM.
    return docs.withColumn(score_col, arrow_function(run, "double")(F.col(text_col)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held_out: int = 0, threshold: float = 0.5, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score in 0..1, predicted (1 from threshold on).

    The cut-off of the text's language is at score 0.5. Null texts score as empty ones; a null doc_id is
    not held out. Without labels every score is 0.5.
    """
    model = train(docs, labels, label, parts, held_out, per_class, id_col, text_col)
    scored = with_toxicity(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), parts) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
