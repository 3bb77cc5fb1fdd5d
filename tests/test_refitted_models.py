"""Boosted trees, stepped forecasts and refitted backtests against plain loops."""

import datetime as dt
import math
import os
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from joblore.operators import backtest, forecast, learn, series
from joblore.plans import catalog
from tests.test_cleaning_and_series import at

START = at("2024-01-01")
FREE = {dt.date(2024, 1, 15)}


def load(days=30, keys="ab", seed=1):
    r = np.random.default_rng(seed)
    return [(k, START + dt.timedelta(hours=i), int(20 + 30 * (9 <= i % 24 <= 16 and i // 24 % 7 < 5) + r.integers(0, 9)), float(i % 7)) for k in keys for i in range(24 * days)]


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, timestamp_hour timestamp, report_count long, backlog double")


def plain_row(ts, past, more=(), short="zero"):
    """The features of an hour, from the list of the values before it."""
    lag = lambda n: past[-n] if len(past) >= n else (past[-1] if short == "last" and past else 0.0)
    mean = lambda n: statistics.fmean(past[-n:]) if past else 0.0
    std = lambda n: statistics.stdev(past[-n:]) if len(past) > 1 else 0.0
    off = float(ts.weekday() >= 5 or ts.date() in FREE)
    turns = [f(2 * math.pi * x / p) for x, p in ((ts.hour, 24), (ts.weekday(), 7)) for f in (math.sin, math.cos)]
    return [1.0, *turns, off, off * (8 <= ts.hour <= 18), lag(1), lag(2), lag(3), lag(24), lag(168), mean(3), mean(24), mean(168), std(3), std(24), *more]


def plain_recursion(times, y, side, periods, buffer, ahead, short="zero", ridge=1.0, pct=None):
    x = np.array([plain_row(t, y[max(0, i - buffer) : i], side[i], short) for i, t in enumerate(times)])
    first = min(168, len(y) // 2)
    weight = np.linalg.solve(x[first:].T @ x[first:] + ridge * np.eye(x.shape[1]), x[first:].T @ np.array(y[first:]))
    past, out = list(y[-buffer:]), []
    for step in range(periods):
        ts = times[-1] + dt.timedelta(hours=step + 1)
        value = max(0.0, float(np.array(plain_row(ts, past, ahead[step], short)) @ weight))
        off = lambda t: t.weekday() >= 5 or t.date() in FREE
        if pct is not None and not off(ts) and off(ts - dt.timedelta(days=1)):
            value *= 1 + pct
        out.append(value)
        past = [*past, value][-buffer:]
    return out


@pytest.mark.parametrize("buffer, short, pct, held", [(200, "zero", None, False), (168, "last", 0.1, True)])
def test_steps_are_those_of_a_plain_loop(spark, buffer, short, pct, held):
    rows = [*load(20, "ab"), *load(3, "c", 2)]  # c is shorter than the longest lag
    options = {"held": {"backlog": 4.0}} if held else {"extra": ["backlog"]}
    got = forecast.recursive_forecast(table(spark, rows), 60, ["k"], ["2024-01-15"], buffer=buffer, short=short, return_pct=pct, **options).orderBy("k", "step").collect()
    assert len(got) == 180
    for k in "abc":
        own = [r for r in rows if r[0] == k]
        tail = np.array([r[3] for r in own[-24:]])
        slope = np.polyfit(np.arange(24), tail, 1)[0]
        ahead = [[4.0] if held else [max(0.0, tail[-1] + slope * (i + 1))] for i in range(60)]
        expected = plain_recursion([r[1] for r in own], [float(r[2]) for r in own], [[r[3]] for r in own], 60, buffer, ahead, short, pct=pct)
        assert [r.y_pred for r in got if r.k == k] == pytest.approx(expected, rel=1e-6, abs=1e-6)


def test_series_are_stepped_alike_alone_and_together(spark, monkeypatch):
    rows = [*load(15, "abcde"), *((None, *r[1:]) for r in load(15, "a", 7))]
    df = table(spark, rows)
    for options in ({"spike_trees": 3}, {"trees": 5, "spike_trees": 3}):
        values = []
        for size in (1, 4, 256):
            monkeypatch.setattr(forecast, "TOGETHER", size)
            values.append({(r.k, r.step): (r.y_pred, r.p_spike) for r in forecast.recursive_forecast(df, 30, ["k"], **options).collect()})
        assert len(values[0]) == 180
        assert all(values[i][x] == pytest.approx(values[0][x]) for i in (1, 2) for x in values[0])
        assert all(0 < p < 1 for _, p in values[0].values())
    assert forecast.recursive_forecast(df.limit(0), 5, ["k"]).count() == 0


def test_trees(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = np.where(x[:, 0] > 0.3, 5.0, 0.0) + (x[:, 1] > 1) * (x[:, 2] < 0) * 4
    model = learn.boost(x[:2000], y[:2000], trees=60)
    assert np.abs(model(x[2000:]) - y[2000:]).mean() < 0.15 * np.abs(y - y.mean()).mean()
    p = learn.odds(learn.boost(x[:2000], (y[:2000] > 3).astype(float), spikes=True, trees=30)(x[2000:]))
    assert ((p > 0.5) == (y[2000:] > 3)).mean() > 0.98
    one = []  # walking each tree by hand
    for row in x[:50]:
        total = model.base
        for f, cut, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > cut[node])
            total += leaf[node - len(f)]
        one.append(total)
    assert model(x[:50]) == pytest.approx(one) and learn.together([model, model])(x[:2]) == pytest.approx(one[:2])
    flat = learn.boost(np.zeros((10, 2)), np.full(10, 3.0), trees=4)
    assert flat(np.zeros((2, 2))) == pytest.approx([3.0, 3.0]) and len(learn.boost(x[:0], y[:0], trees=2)(x[:3])) == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the tables are not here")
def test_trees_by_series_beat_the_naive_forecast(spark):
    """On the tables' series, of each report type."""
    train, test = catalog._series_halves(spark, "/root/testdata/sf0.1")
    got = forecast.score_by_series(train, test, ["report_type"], catalog.SERIES_FEATURES)
    errors = got.groupBy("report_type").agg(*(F.avg(F.abs(F.col("report_count") - F.col(c))).alias(c) for c in ("y_pred", "y_lag_1"))).collect()
    assert len(errors) == 5 and all(r.y_pred < r.y_lag_1 for r in errors) and got.count() == test.count()
    assert got.filter("p_spike between 0 and 1 and y_pred >= 0").count() == test.count()


def test_scores_without_keys_and_without_training_rows(spark):
    train, test = (table(spark, load(days, "a", seed)).withColumn("hour", F.hour("timestamp_hour")) for days, seed in ((20, 1), (3, 2)))
    got = forecast.score_by_series(train, test, [], ["hour"])
    assert got.columns == [*test.columns, "y_pred", "p_spike"] and got.filter("y_pred is null").count() == 0
    other = forecast.score_by_series(train, test.withColumn("k", F.lit("z")), ["k"], ["hour"])
    assert other.count() == 72 and other.filter("y_pred is null and p_spike is null").count() == 72


def plain_folds(times, y, n, penalty):
    """[(fold, train rows, test rows, mae, mase)]"""
    size, out = len(y) // (n + 1), []
    for fold in range(1, n + 1):
        start = len(y) - (n - fold + 1) * size
        x = np.array([plain_row(t, y[max(0, i - 200) : i]) for i, t in enumerate(times[: start + size])])
        first = min(168, start // 2)
        weight = np.linalg.solve(x[first:start].T @ x[first:start] + penalty * np.eye(x.shape[1]), x[first:start].T @ np.array(y[first:start]))
        mae = np.mean([abs(max(0.0, x[i] @ weight) - y[i]) for i in range(start, start + size)])
        out.append((fold, start, size, mae, mae / np.mean(np.abs(np.diff(y[:start])))))
    return out


def test_folds_and_grid_against_plain_loops(spark):
    rows = load(25, "ab")
    got = backtest.grid_search(table(spark, rows), [{"ridge": 1.0}, {"ridge": 50.0}, {"trees": 10, "depth": 2}], 2, ["k"], ["2024-01-15"]).collect()
    assert len(got) == 12
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        for index, penalty in enumerate((1.0, 50.0)):
            folds = sorted((r.fold, r.n_train, r.n_test, r.mae, r.mase) for r in got if r.k == k and r.config_index == index)
            for a, b in zip(folds, plain_folds([r[1] for r in own], [float(r[2]) for r in own], 2, penalty), strict=True):
                assert a == pytest.approx(b)
    mean = backtest.config_metrics(backtest.grid_search(table(spark, rows), [{"ridge": 1.0}, {"trees": 10}], 2, ["k"]), ["k"])
    best = forecast.best_config(mean.filter("k = 'a'"), 1.0).first()
    assert best.mase == min(r.mase for r in mean.collect() if r.k == "a") and best.folds == 2
    one = backtest.walk_forward_refit(table(spark, load(20, "a")).drop("k"), n=2)
    assert one.columns == ["fold", "n_train", "n_test", "mae", "mase"] and one.count() == 2
    assert backtest.walk_forward_refit(table(spark, load(1, "a")[:1]), keys=["k"]).count() == 0


def test_every_cut_off_is_fitted_and_stepped_anew(spark):
    rows = load(20, "ab")
    got = backtest.rolling_origin_refit(table(spark, rows), 336, 60, 12, keys=["k"], holidays=["2024-01-15"]).collect()
    cuts = sorted({r.cut for r in got})
    assert cuts == [336, 396, 456]
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        for cut in cuts:
            expected = plain_recursion([r[1] for r in own[:cut]], [float(r[2]) for r in own[:cut]], [[]] * cut, 12, 200, [[]] * 12)
            mine = sorted((r.step, r.ds, r.y, r.pred) for r in got if r.k == k and r.cut == cut)
            assert [r[3] for r in mine] == pytest.approx(expected, rel=1e-6, abs=1e-6)
            assert [(r[1], r[2]) for r in mine] == [(o[1], float(o[2])) for o in own[cut : cut + 12]]
    assert backtest.rolling_origin_refit(table(spark, load(5, "a")), keys=["k"]).count() == 0


def test_maps_with_keys_are_those_of_each_series(spark):
    rows = [(*r, h, float(y)) for r, h, y in ((r, r[1].hour, r[2]) for r in load(30))]
    df = spark.createDataFrame(rows, "k string, timestamp_hour timestamp, report_count long, backlog double, hour int, y double").withColumn("y_pred", F.col("backlog") * 5)
    makers = [lambda d, keys: forecast.hourly_bias(d, keys=keys), lambda d, keys: forecast.hourly_floor(d, keys=keys), lambda d, keys: forecast.spike_profile(d, keys=keys), lambda d, keys: forecast.seasonal_table(d, 2, keys=keys)]
    for make in makers:
        both = make(df, ["k"])
        for k in "ab":
            assert sorted(map(tuple, both.filter(F.col("k") == k).drop("k").collect())) == sorted(map(tuple, make(df.filter(F.col("k") == k), []).select(*both.drop("k").columns).collect()))
    assert series.fourier_features(df, ["k"]).count() == len(rows)
