"""Backtests that fit a model anew for each fold, cut-off and configuration, and the search for the best one.

Each (series, fold) or (series, fold, configuration) is a group of its own, so all models are fitted in parallel
after one shuffle; a group is a series' hourly rows. Cut-offs of a series share its rows: sums of products up to each
cut-off give every cut-off's ridge regression from one pass, and all cut-offs are stepped together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.operators import learn
from joblore.operators.evaluate import _mae, _rmse, walk_forward_folds

#: A ridge regression; boosted trees have instead trees, depth and rate.
RIDGE = {"ridge": 1.0}


def _free(holidays: Sequence[str]) -> np.ndarray:
    return np.array(sorted({np.datetime64(d, "D").astype(np.int64) for d in holidays}), np.int64)


def _fitted(x: np.ndarray, y: np.ndarray, config: Mapping[str, float]):
    """A function from features to predictions, at least 0."""
    if config.get("trees"):
        model = learn.boost(x, y, None, int(config["trees"]), int(config.get("depth") or 3), float(config.get("rate") or 0.2))
        return lambda new: np.maximum(0.0, model(new))
    weight = learn.ridge(x, y, float(config.get("ridge", 1.0)))
    return lambda new: np.maximum(0.0, new @ weight)


def grid_search(h: DataFrame, configs: Sequence[Mapping[str, float]], n: int = 5, keys: Sequence[str] = (), holidays: Sequence[str] = ()) -> DataFrame:
    """(keys, config_index, fold, n_train, n_test, mae, mase): each configuration fitted on each expanding fold of each series.

    A test hour is predicted from the values before it, as in the fold's training. mase divides by the fold's mean step from
    one train hour to the next, or where that is 0 by that of the whole series (plus 1e-8). Folds whose train or test part is
    empty have no row. The rows are hours with gaps filled; h is repeated for each fold and configuration.
    """
    kinds, free = dict(h.dtypes), _free(holidays)
    folds = walk_forward_folds(h.select(*keys, "timestamp_hour", "report_count"), n, keys=keys).withColumn("config_index", F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1))))
    steps = h.select(*keys, F.abs(F.col("report_count") - F.lag("report_count").over(W.partitionBy(*keys).orderBy("timestamp_hour"))).cast("double").alias("d"))
    whole = steps.groupBy(*keys).agg(F.avg("d").alias("__whole"))

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("timestamp_hour")
        y, train = rows["report_count"].to_numpy(dtype=float), (rows["part"] == "train").to_numpy()
        x = learn.series_features(y, learn.hours_of(rows["timestamp_hour"]), free, np.zeros((len(y), 0)))
        first = learn.first_row(int(train.sum()))
        learned = train & (np.arange(len(y)) >= first)
        columns = [*keys, "config_index", "fold", "n_train", "n_test", "mae", "naive"]
        if not learned.any() or train.all():
            return pd.DataFrame([], columns=columns)
        config = configs[int(rows["config_index"].iloc[0])]
        error = np.abs(_fitted(x[learned], y[learned], config)(x[~train]) - y[~train])
        step = np.abs(np.diff(y[train]))
        own = [rows[k].iloc[0] for k in keys] + [int(rows["config_index"].iloc[0]), int(rows["fold"].iloc[0]), int(train.sum()), int((~train).sum()), float(error.mean()), float(step.mean()) if len(step) else 0.0]
        return pd.DataFrame([own], columns=columns)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "config_index int, fold int, n_train long, n_test long, mae double, naive double"])
    out = folds.groupBy(*keys, "config_index", "fold").applyInPandas(judge, schema)
    out = out.join(whole, list(keys), "left") if keys else out.crossJoin(F.broadcast(whole))
    divisor = F.when(F.col("naive") > 1e-8, F.col("naive")).otherwise(F.coalesce("__whole", F.lit(0.0)) + 1e-8)
    return out.withColumn("mase", F.col("mae") / divisor).drop("naive", "__whole")


def walk_forward_refit(h: DataFrame, config: Mapping[str, float] = RIDGE, n: int = 5, keys: Sequence[str] = (), holidays: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, n_train, n_test, mae, mase) of a model fitted anew on each fold."""
    return grid_search(h, [config], n, keys, holidays).drop("config_index")


def config_metrics(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, config_index, folds, mae, mase): means over the folds of grid_search, what best_config picks from."""
    return results.groupBy(*keys, "config_index").agg(F.count("*").alias("folds"), F.avg("mae").alias("mae"), F.avg("mase").alias("mase"))


def rolling_origin_refit(h: DataFrame, initial: int = 336, period: int = 72, horizon: int = 24, ridge: float = 1.0, buffer: int = 200, keys: Sequence[str] = (), holidays: Sequence[str] = ()) -> DataFrame:
    """(keys, cut, step, ds, y, pred): at each cut-off a ridge regression of the rows before, stepped over the horizon.

    cut counts the rows that were known. Cut-offs lie every `period` rows after the first `initial` ones, as long as a whole
    horizon follows. Predictions are fed back, as in recursive_forecast, and at least 0.
    """
    kinds, free = dict(h.dtypes), _free(holidays)

    def backtest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("timestamp_hour")
        y, times = rows["report_count"].to_numpy(dtype=float), learn.hours_of(rows["timestamp_hour"])
        cuts = np.arange(initial, len(y) - horizon + 1, period)
        columns = [*keys, "cut", "step", "ds", "y", "pred"]
        if not len(cuts):
            return pd.DataFrame([], columns=columns)
        x = learn.series_features(y, times, free, np.zeros((len(y), 0)), reach=buffer)
        square, product, weights = np.zeros((x.shape[1], x.shape[1])), np.zeros(x.shape[1]), []
        at = 0
        firsts = [learn.first_row(c) for c in cuts]
        for cut, first in zip(cuts.tolist(), firsts, strict=True):
            square, product = square + x[at:cut].T @ x[at:cut], product + x[at:cut].T @ y[at:cut]
            at = cut
            head = x[:first]  # what this cut-off doesn't learn from
            weights.append(np.linalg.solve(square - head.T @ head + ridge * np.eye(x.shape[1]), product - head.T @ y[:first]))
        weight = np.stack(weights)
        past, size = np.zeros((len(cuts), buffer)), np.minimum(cuts, buffer)
        for row, cut, n in zip(past, cuts, size, strict=True):
            row[buffer - n :] = y[cut - n : cut]
        pred, none = np.empty((len(cuts), horizon)), np.zeros((len(cuts), 0))
        for step in range(horizon):
            hours = times[cuts - 1] + step + 1
            pred[:, step] = np.maximum(0.0, (learn.step_features(past, size, hours, free, none) * weight).sum(axis=1))
            past, size = np.concatenate([past[:, 1:], pred[:, [step]]], axis=1), np.minimum(size + 1, buffer)
        place = (cuts[:, None] + np.arange(horizon)).ravel()
        out = {k: [rows[k].iloc[0]] * len(place) for k in keys}
        out |= {"cut": np.repeat(cuts, horizon), "step": np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(cuts)), "ds": rows["timestamp_hour"].to_numpy()[place], "y": y[place], "pred": pred.ravel()}
        return pd.DataFrame(out, columns=columns)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "cut long, step int, ds timestamp, y double, pred double"])
    return h.select(*keys, "timestamp_hour", "report_count").groupBy(*keys).applyInPandas(backtest, schema)


def errors_by_step(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step, n, mae, rmse) over the cut-offs of rolling_origin_refit."""
    return predictions.groupBy(*keys, "step").agg(F.count("*").alias("n"), _mae("y", "pred").alias("mae"), _rmse("y", "pred").alias("rmse"))
