"""Quality classifier: a sparse ensemble of rules over text statistics, scored as Spark columns.

Boosted regression trees are grown on statistics of labelled texts; the path to each node is a rule, a
conjunction of comparisons; a logistic model with an L1 penalty picks and weighs rules. The kept rules
compile into one column expression, so scoring runs in the JVM on whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblore.llm.labels import remainder, training_rows

#: Labelled texts of each class that are fitted, at most.
PER_CLASS = 8000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text without nulls; each is finite for every text."""
    size = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    count = lambda c: (F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    symbols = ["#", "$", "%", "&", "*", "|", "!", "?", "@", "<", ">", "=", "{", "}", "_", "\\", "/"]
    return {
        "chars": F.log1p(F.char_length(text).cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": (F.char_length(text).cast("double") - F.size(words)) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": n_words / n_lines,
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / size,
        "digits": F.regexp_count(text, F.lit("[0-9]")) / size,
        "commas": count(",") / n_words,
        "full_stops": count(".") / n_words,
    } | {f"symbol_{ord(c)}": count(c) / n_words for c in symbols}


@dataclass
class Rule:
    """Comparisons (statistic, greater, threshold), all of which must hold; and a weight."""

    terms: list[tuple[str, bool, float]]
    weight: float = 0.0

    def column(self) -> Column:
        out = None
        for name, greater, threshold in self.terms:
            term = F.col(name) > threshold if greater else F.col(name) <= threshold
            out = term if out is None else out & term
        return out

    def holds(self, names: list[str], x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, names.index(n)] > t) == greater for n, greater, t in self.terms])


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, over columns named as the statistics."""
        total = F.lit(float(self.intercept))
        for rule in self.rules:
            total = total + F.when(rule.column(), float(rule.weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, edges: list[np.ndarray], names: list[str], residual: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int, terms: list, rules: list[Rule], out: np.ndarray, least: int) -> None:
    """Split rows on the best threshold; note each node's path as a rule, and each leaf's step in out."""
    best = (1e-9, None, None)
    g, h = residual[rows], curve[rows]
    base = g.sum() ** 2 / (h.sum() + 1.0)
    if depth:
        for f in range(x.shape[1]):
            bins = np.searchsorted(edges[f], x[rows, f], side="left")
            k = len(edges[f]) + 1
            gs, hs, n = (np.cumsum(np.bincount(bins, w, k))[:-1] for w in (g, h, None))
            if len(gs):
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base
                gain[(n < least) | (len(rows) - n < least)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, float(edges[f][i]))
    if best[1] is None:
        out[rows] = g.sum() / (h.sum() + 1.0)
        return
    _, f, threshold = best
    above = x[rows, f] > threshold
    for greater, own in ((False, rows[~above]), (True, rows[above])):
        path = [*terms, (names[f], greater, threshold)]
        rules.append(Rule(path))
        _grow(x, edges, names, residual, curve, own, depth - 1, path, rules, out, least)


def _lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps."""
    step = 4.0 / (float(np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2) + weight.sum())
    w, b = np.zeros(z.shape[1]), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(z @ v + c, -40, 40))) - y)
        new = v - step * (z.T @ error)
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        bias, more = c - step * error.sum(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / more * (new - w), bias + (t - 1) / more * (bias - b)
        w, b, t = new, bias, more
    return w, b


def fit(names: list[str], x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 0.0003, bins: int = 64, rounds: int = 400, seed: int = 5) -> RuleEnsemble:
    """Rules and weights from statistics x (rows by names), labels y and row weights of mean 1."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    share = float((weight * y).sum() / weight.sum())
    margin, rules = np.full(len(y), np.log(share / (1 - share))), []
    random = np.random.default_rng(seed)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        part = np.flatnonzero(random.random(len(y)) < 0.7)
        step = np.zeros(len(y))
        own: list[Rule] = []
        _grow(x, edges, names, weight * (y - p), weight * p * (1 - p), part, depth, [], own, step, max(2, len(y) // 1000))
        rest = np.setdiff1d(np.arange(len(y)), part)
        if len(rest) and own:  # leaves of the rows that were left out
            for rule in own:
                hold, inside = rule.holds(names, x[rest]), rule.holds(names, x[part])
                if inside.any():
                    step[rest[hold]] = step[part[inside]].mean()
        margin += rate * step
        rules += own
    distinct: dict[bytes, Rule] = {}
    columns = []
    for rule in rules:
        hold = rule.holds(names, x)
        if 0 < hold.sum() < len(y) and distinct.setdefault(np.packbits(hold).tobytes(), rule) is rule:
            columns.append(hold)
    kept = list(distinct.values())
    if not kept:
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    z = np.stack(columns, axis=1).astype(np.float64)
    w, b = _lasso(z, y, weight / weight.sum(), penalty, rounds)
    for rule, own in zip(kept, w, strict=True):
        rule.weight = float(own)
    return RuleEnsemble([r for r in kept if r.weight != 0], float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held_out: int = 2, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> RuleEnsemble:
    """A model of `label` from whole texts of at most per_class labelled documents of each class, which
    weigh as much as all labelled documents of their class."""
    rows = training_rows(docs, labels, label, parts, held_out, per_class, id_col, text_col)
    stats = statistics(F.col("text"))
    table = rows.select("doc_id", "label", "weight", *(c.cast("double").alias(n) for n, c in stats.items())).toPandas().sort_values("doc_id")
    y = table["label"].to_numpy(dtype=np.float64)
    weight = table["weight"].to_numpy(dtype=np.float64)
    return fit(list(stats), table[list(stats)].to_numpy(dtype=np.float64), y, weight / weight.mean() if len(y) else weight)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held_out: int = 2, threshold: float = 0.7, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score in 0..1, predicted (1 from threshold on).

    Null texts score as empty ones; a null doc_id is not held out. Without labels every score is 0.5.
    Columns of docs other than the id and the text are ignored.
    """
    model = train(docs, labels, label, parts, held_out, per_class, id_col, text_col)
    stats = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc_id", *(c.cast("double").alias(n) for n, c in statistics(F.col("text")).items()))
    scored = stats.select("doc_id", F.coalesce(remainder(F.col("doc_id"), parts) == held_out, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
