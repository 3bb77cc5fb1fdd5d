"""Models of one hourly series, as arrays: features, ridge regression and boosted trees.

Tasks call these for the series they hold; a series is 8,760 rows a year. Everything works on many rows at once, and the
recursive steps on many series at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

PEAK = (8, 18)
LAGS, MEANS, STDS = (1, 2, 3, 24, 168), (3, 24, 168), (3, 24)


def hours_of(times) -> np.ndarray:
    """Whole hours since 1970 of a column of timestamps."""
    return np.asarray(times, dtype="datetime64[h]").astype(np.int64)


def calendar(hours: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hour of day, weekday from Monday, whether the day is a weekend's or among the free days since 1970)."""
    days = hours // 24
    weekday = (days + 3) % 7
    return hours % 24, weekday, (weekday >= 5) | np.isin(days, free)


def _known(hours: np.ndarray, free: np.ndarray) -> np.ndarray:
    hour, weekday, off = calendar(hours, free)
    turns = [f(2 * np.pi * x / p) for x, p in ((hour, 24), (weekday, 7)) for f in (np.sin, np.cos)]
    busy = (hour >= PEAK[0]) & (hour <= PEAK[1])
    return np.stack([np.ones(len(hours)), *turns, off.astype(float), (off & busy).astype(float)], axis=1)


def step_features(past: np.ndarray, size: np.ndarray, hours: np.ndarray, free: np.ndarray, side: np.ndarray, short: str = "zero") -> np.ndarray:
    """Features of the next hour of several series. past: their last values, aligned right; size: how many each has.

    A lag beyond a series' start is 0, or with short="last" its last value; means and deviations take what there is.
    """
    width, out = past.shape[1], [_known(hours, free)]
    last = past[:, -1] if short == "last" else np.zeros(len(past))
    lags = [np.where(size >= n, past[:, -n] if n <= width else 0.0, last) for n in LAGS]
    place = np.arange(width)[None, ::-1]  # 0 for the last value
    for n, deviation in [*((n, False) for n in MEANS), *((n, True) for n in STDS)]:
        held = place < np.minimum(n, size)[:, None]
        count = held.sum(axis=1)
        mean = np.where(held, past, 0.0).sum(axis=1) / np.maximum(count, 1)
        if deviation:
            gap = np.where(held, past - mean[:, None], 0.0)
            lags.append(np.sqrt((gap**2).sum(axis=1) / np.maximum(count - 1, 1)))
        else:
            lags.append(mean)
    return np.concatenate([*out, np.stack(lags, axis=1), side], axis=1)


def series_features(y: np.ndarray, hours: np.ndarray, free: np.ndarray, side: np.ndarray, short: str = "zero", reach: int = 200, rows: int = 4096) -> np.ndarray:
    """Features of every hour of a series, as step_features makes them of the `reach` values before it."""
    padded = np.concatenate([np.zeros(reach), y])
    windows = np.lib.stride_tricks.sliding_window_view(padded, reach)[: len(y)]
    size = np.minimum(np.arange(len(y)), reach)
    parts = [step_features(windows[i : i + rows], size[i : i + rows], hours[i : i + rows], free, side[i : i + rows], short) for i in range(0, len(y), rows)]
    return np.concatenate(parts) if parts else np.zeros((0, 7 + len(LAGS) + len(MEANS) + len(STDS) + side.shape[1]))


def first_row(n: int) -> int:
    """Rows before lack most of their lags and aren't learned from."""
    return min(max(LAGS), n // 2)


def ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    return np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ y)


@dataclass
class Trees:
    """An ensemble of whole trees of one depth: inner nodes as heaps, leaves behind them. value = base + sum of leaves."""

    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2^depth)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return together([self])(np.repeat(x[:, None, :], 1, axis=1)) if len(x) else np.zeros(0)


def together(models: Sequence[Trees]):
    """A function of (rows, models, features), or (models, features), to what each model says of its own features."""
    base = np.array([m.base for m in models])
    feature, threshold, leaf = (np.stack([getattr(m, c) for m in models]) for c in ("feature", "threshold", "leaf"))
    model, tree = np.arange(len(models))[:, None], np.arange(feature.shape[1])[None, :]
    inner = feature.shape[2]

    def values(x: np.ndarray) -> np.ndarray:
        rows = x.reshape(-1, len(models), x.shape[-1])
        out = np.empty(rows.shape[:2])
        for i, row in enumerate(rows) if len(models) > 1 else []:
            node = np.zeros(feature.shape[:2], np.int64)
            while node.size and node[0, 0] < inner:
                node = 2 * node + 1 + (row[model, feature[model, tree, node]] > threshold[model, tree, node])
            out[i] = base + leaf[model, tree, node - inner].sum(axis=1)
        if len(models) == 1:  # many rows of one model
            own, total = rows[:, 0, :], np.full(len(rows), base[0])
            at = np.arange(len(own))
            for t in range(feature.shape[1]):
                node = np.zeros(len(own), np.int64)
                for _ in range(int(np.log2(inner + 1))):
                    node = 2 * node + 1 + (own[at, feature[0, t, node]] > threshold[0, t, node])
                total += leaf[0, t, node - inner]
            out[:, 0] = total
        return out.reshape(-1) if x.ndim == 2 or len(models) == 1 else out

    return values


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 20, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, spikes: bool = False, penalty: float = 1.0) -> Trees:
    """Boosted trees by histograms: each feature is cut at quantiles, and a node splits where sums of gradients part best.

    spikes: y is 0 or 1, and the ensemble's value the logarithm of the odds (log loss); else squared error. least: the
    weight that each side of a split keeps. A node that no split improves passes all its rows to the left.
    """
    n, inner = len(y), (1 << depth) - 1
    weight = np.ones(n) if weight is None else weight
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    mean = float(np.average(y, weights=weight)) if n and weight.sum() > 0 else 0.0
    base = float(np.log((mean + 1e-3) / (1 - mean + 1e-3))) if spikes else mean
    if not n:
        return Trees(base, feature, threshold, leaf)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    width = bins + 1
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # code <= i: x <= cuts[i]
    value = np.full(n, base)
    offset = np.arange(x.shape[1]) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-value)) if spikes else value
        gradient, hessian = weight * (y - p), weight * (np.maximum(p * (1 - p), 1e-6) if spikes else 1.0)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (x.shape[1] * width) + offset + code).ravel()
            shape = (count, x.shape[1], width)
            g, h, w = (np.bincount(at, np.repeat(v, x.shape[1]), np.prod(shape)).reshape(shape).cumsum(axis=2) for v in (gradient, hessian, weight))
            g_all, h_all, w_all = (v[:, :, -1:] for v in (g, h, w))
            gain = g**2 / (h + penalty) + (g_all - g) ** 2 / (h_all - h + penalty) - g_all**2 / (h_all + penalty)
            gain[(w < least) | (w_all - w < least)] = -1.0
            best = gain.reshape(count, -1).argmax(axis=1)
            f, b = best // width, best % width
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            feature[t, first : first + count] = np.where(good, f, 0)
            threshold[t, first : first + count] = [cuts[i][j] if ok and j < len(cuts[i]) else np.inf for i, j, ok in zip(f, b, good, strict=True)]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        end = node - inner
        leaf[t] = rate * np.bincount(end, gradient, inner + 1) / (np.bincount(end, hessian, inner + 1) + penalty)
        value = value + leaf[t][end]
    return Trees(base, feature, threshold, leaf)


def odds(value: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-value))


def projected(values: np.ndarray, steps: int, n: int = 24) -> np.ndarray:
    """For each step ahead the last value plus the slope of the last n, at least 0."""
    tail = values[-n:]
    i = np.arange(len(tail), dtype=float)
    spread = ((i - i.mean()) ** 2).sum() if len(tail) else 0.0
    slope = ((i - i.mean()) * (tail - tail.mean())).sum() / spread if spread > 0 else 0.0
    return np.maximum(0.0, (tail[-1] if len(tail) else 0.0) + slope * np.arange(1, steps + 1))
