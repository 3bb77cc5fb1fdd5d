"""Calibration of forecasts, point and recursive forecasts, horizon planning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.functions.columns import positive
from joblore.operators import learn
from joblore.operators.learn import PEAK
from joblore.operators.series import calendar_features, cyclic_features, tail_window

#: Features of the point model that need no future values.
POINT_FEATURES = (
    "hour", "weekday", "day_of_month", "month", "is_weekend", "is_holiday", "is_peak_hour", "is_month_end", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos",
    "y_lag_1", "y_lag_24", "y_lag_168", "y_rolling_mean_3", "y_rolling_mean_24", "y_rolling_mean_168", "backlog", "avg_param_span_days",
)


def _grid(df: DataFrame, keys: Sequence[str], **cells: int) -> DataFrame:
    """Every cell of each series (of none: of all): columns that count from 0."""
    out = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    for name, n in cells.items():
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out


def _with(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """df joined to one row a series; without keys to the only row."""
    return df.join(side, list(keys), how) if keys else df.crossJoin(F.broadcast(side))


def sample_weights(train: DataFrame, y: str = "report_count") -> DataFrame:
    """weight = max(y^2 / mean(y^2), 1)."""
    mean = train.agg(F.avg(F.pow(F.col(y).cast("double"), F.lit(2))).alias("__m"))
    weight = F.greatest(F.coalesce(F.try_divide(F.pow(F.col(y).cast("double"), F.lit(2)), F.col("__m")), F.lit(1.0)), F.lit(1.0))
    return train.crossJoin(F.broadcast(mean)).withColumn("weight", weight).drop("__m")


def hourly_bias(test: DataFrame, y: str = "y", pred: str = "y_pred", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, hour, value): median of y - pred, to 4 places; 0 for hours without rows."""
    own = test.groupBy(*keys, "hour").agg(F.round(F.percentile(F.col(y) - F.col(pred), 0.5), 4).alias("value"))
    return _grid(test, keys, hour=24).join(own, [*keys, "hour"], "left").fillna(0.0, "value")


def hourly_floor(train: DataFrame, y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, hour, value): P25 to 2 places, 0 where P75 is not positive."""
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.75)))
    return train.groupBy(*keys, "hour").agg(q.alias("q")).select(*keys, "hour", F.when(F.col("q")[1] > 0, F.round(F.col("q")[0], 2)).otherwise(0.0).alias("value"))


def spike_profile(train: DataFrame, y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, hour, threshold, overall_mean, spike_mean): mean of y above the 75th percentile; hours without such rows are absent."""
    p75 = train.groupBy(*keys).agg(F.percentile(y, 0.75).alias("threshold"))
    above = _with(train, p75, keys).filter(F.col(y) > F.col("threshold"))
    overall = above.groupBy(*keys).agg(F.round(F.avg(y), 2).alias("overall_mean"))
    return _with(above.groupBy(*keys, "hour", "threshold").agg(F.round(F.avg(y), 2).alias("spike_mean")), overall, keys)


def seasonal_table(h: DataFrame, weeks: int = 4, y: str = "report_count", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, weekday, hour, seasonal) for all 168 cells: mean of the last weeks; else the hour's mean; else 0."""
    tail = tail_window(h, keys, weeks * 168).withColumns({"weekday": F.weekday("timestamp_hour"), "hour": F.hour("timestamp_hour")})
    cells = tail.groupBy(*keys, "weekday", "hour").agg(F.avg(y).alias("cell"))
    hours = tail.groupBy(*keys, "hour").agg(F.avg(y).alias("hour_mean"))
    out = _grid(h, keys, hour=24, weekday=7).join(cells, [*keys, "weekday", "hour"], "left").join(hours, [*keys, "hour"], "left")
    return out.select(*keys, "weekday", "hour", F.coalesce("cell", "hour_mean", F.lit(0.0)).alias("seasonal"))


def trend_tail(h: DataFrame, column: str, n: int = 24, steps: int = 24, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step, projected): the last value plus the slope of the last n rows, for each step ahead, at least 0."""
    order = W.partitionBy(*keys).orderBy("timestamp_hour")
    tail = tail_window(h, keys, n).withColumns({"__i": F.row_number().over(order).cast("double"), "__x": F.col(column).cast("double")})
    fit = tail.groupBy(*keys).agg(F.coalesce(F.regr_slope("__x", "__i"), F.lit(0.0)).alias("slope"), F.max_by("__x", "__i").alias("last"))
    return fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(*keys, "step", positive(F.col("last") + F.col("slope") * F.col("step")).alias("projected"))


def future_grid(h: DataFrame, holidays: DataFrame, periods: int = 312, keys: Sequence[str] = (), k: int = 3) -> DataFrame:
    """The next hours of each series with step (from 0), calendar, cyclic and Fourier features; time goes on."""
    span = h.groupBy(*keys).agg(F.max("timestamp_hour").alias("last"), F.min("timestamp_hour").alias("first")).filter("last is not null")
    grid = span.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    grid = grid.withColumn("timestamp_hour", F.timestamp_seconds(F.unix_seconds("last") + (F.col("step") + 1) * 3600))
    t = (F.unix_seconds("timestamp_hour") - F.unix_seconds("first")) / 3600
    turns = {f"fourier_{name}_{f}_{i}": getattr(F, f)(t * i * F.lit(2 * np.pi) / F.lit(float(p))) for name, p in (("daily", 24), ("weekly", 168)) for i in range(1, k + 1) for f in ("sin", "cos")}
    return cyclic_features(calendar_features(grid.withColumns(turns).drop("last", "first"), holidays))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    df = df.fillna(0, list(features))
    return VectorAssembler(inputCols=list(features), outputCol="__x").transform(df)


def fit_point_model(train: DataFrame, features: Sequence[str] = POINT_FEATURES, y: str = "report_count", trees: int = 20, depth: int = 4, seed: int = 42):
    """A boosted-tree point model, rows weighted by sample_weights."""
    rows = _assembled(sample_weights(train, y), features)
    return GBTRegressor(featuresCol="__x", labelCol=y, weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed, predictionCol="y_pred").fit(rows)


def score_point_model(model, df: DataFrame, features: Sequence[str] = POINT_FEATURES) -> DataFrame:
    """df with y_pred, at least 0; missing features count 0."""
    return model.transform(_assembled(df, features)).drop("__x").withColumn("y_pred", positive(F.col("y_pred")))


def quantile_bands(df: DataFrame, scored: DataFrame, low: float = 0.025, high: float = 0.975, y: str = "y", pred: str = "y_pred") -> DataFrame:
    """df with y_p10 and y_p90: its forecast plus quantiles of the scored rows' residuals of that hour, at least 0."""
    q = F.percentile(F.col(y) - F.col(pred), F.array(F.lit(low), F.lit(high)))
    bands = scored.groupBy("hour").agg(q.alias("__q"))
    out = df.join(F.broadcast(bands), "hour", "left")
    edge = lambda i: positive(F.col(pred) + F.coalesce(F.col("__q")[i], F.lit(0.0)))
    return out.withColumns({"y_p10": edge(0), "y_p90": edge(1)}).drop("__q")


def spike_probability(train: DataFrame, df: DataFrame, features: Sequence[str] = POINT_FEATURES, y: str = "report_count", trees: int = 10, seed: int = 42) -> DataFrame:
    """df with p_spike, the probability that y exceeds the train's 75th percentile, by boosted trees."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    p75 = train.agg(F.percentile(y, 0.75).alias("__p75"))
    rows = train.crossJoin(F.broadcast(p75)).withColumn("__spike", (F.col(y) > F.col("__p75")).cast("double")).drop("__p75")
    trainer = GBTClassifier(featuresCol="__x", labelCol="__spike", maxIter=trees, maxDepth=4, seed=seed, predictionCol="__class")
    model = trainer.setProbabilityCol("__p").setRawPredictionCol("__raw").fit(_assembled(rows, features))
    return model.transform(_assembled(df, features)).withColumn("p_spike", vector_to_array("__p")[1]).drop("__x", "__p", "__class", "__raw")


def adjust_forecast(raw: DataFrame, bias: DataFrame, floor: DataFrame, spike: DataFrame, seasonal: DataFrame) -> DataFrame:
    """The five corrections in their fixed order; maps are at most 168 rows and broadcast.

    raw: ds, step (from 0), hour, weekday, y_p10, y_p50, y_p90, p_spike. Returns ds, step, y_p10, y_pred, y_p90.
    """
    spike = spike.select("hour", "spike_mean", "overall_mean")
    overall = spike.agg(F.coalesce(F.max("overall_mean"), F.lit(0.0)).alias("overall"))
    df = raw.join(F.broadcast(seasonal), ["weekday", "hour"], "left").join(F.broadcast(bias.withColumnRenamed("value", "bias")), "hour", "left")
    df = df.join(F.broadcast(floor.withColumnRenamed("value", "floor")), "hour", "left").join(F.broadcast(spike.drop("overall_mean")), "hour", "left").crossJoin(F.broadcast(overall))
    zero = F.lit(0.0)
    alpha = F.least(F.lit(0.4), F.col("step") / 168.0 * 0.4)
    busy = F.col("hour").between(*PEAK) & (F.col("weekday") < 5)
    df = df.withColumn("y", (1 - alpha) * F.col("y_p50") + alpha * F.coalesce("seasonal", zero))
    bands = ("y", "y_p10", "y_p90")
    df = df.withColumns({c: positive(F.col(c) + F.coalesce("bias", zero)) for c in bands})
    df = df.withColumns({c: F.when(busy, F.greatest(F.col(c), F.coalesce("floor", zero))).otherwise(F.col(c)) for c in bands})
    hot = F.col("p_spike") >= 0.5
    df = df.withColumn("y", F.when(hot & busy, 0.5 * F.col("y") + 0.5 * F.coalesce("spike_mean", "overall")).otherwise(F.col("y")))
    half = (F.col("y_p90") - F.col("y_p10")) / 2 * 1.2
    df = df.withColumns({"y_p10": F.when(hot, positive(F.col("y") - half)).otherwise(F.col("y_p10")), "y_p90": F.when(hot, F.col("y") + half).otherwise(F.col("y_p90"))})
    half = (F.col("y_p90") - F.col("y_p10")) / 2 * F.greatest(F.lit(1.0), F.sqrt((F.col("step") + 1) / 24.0))
    return df.select("ds", "step", F.round(positive(F.col("y") - half), 2).alias("y_p10"), F.round("y", 2).alias("y_pred"), F.round(F.col("y") + half, 2).alias("y_p90"))


def series_maps(train: DataFrame, scored: DataFrame, keys: Sequence[str], y: str = "report_count", pred: str = "y_pred", weeks: int = 4) -> DataFrame:
    """(keys, bias, floor, spike, overall, seasonal, low, high, p_spike): what adjust_forecast takes, for each series.

    train: keys, timestamp_hour, y; scored: also pred, rows that the forecast's errors are told from. Maps go
    by hour, seasonal and p_spike by weekday * 24 + hour; p_spike is the share of the train's
    rows of that hour of the week that exceed the series' 75th percentile.
    """
    parts = {"hour": F.hour("timestamp_hour"), "weekday": F.weekday("timestamp_hour")}
    train, scored = train.withColumns(parts), scored.withColumns(parts)
    cell = (F.col("weekday") * 24 + F.col("hour")).alias("cell")
    edges = F.percentile(F.col(y) - F.col(pred), F.array(F.lit(0.025), F.lit(0.975)))
    spike = spike_profile(train, y, keys)
    tables = [
        (hourly_bias(scored, y, pred, keys), "hour", {"bias": "value"}), (scored.groupBy(*keys, "hour").agg(edges.alias("q")), "hour", {"low": F.col("q")[0], "high": F.col("q")[1]}),
        (hourly_floor(train, y, keys), "hour", {"floor": "value"}), (spike, "hour", {"spike": "spike_mean"}),
        (seasonal_table(train, weeks, y, keys).select(*keys, cell, "seasonal"), "cell", {"seasonal": "seasonal"}),
        (_with(train, train.groupBy(*keys).agg(F.percentile(y, 0.75).alias("__p75")), keys).groupBy(*keys, cell).agg(F.avg((F.col(y) > F.col("__p75")).cast("double")).alias("share")), "cell", {"p_spike": "share"}),
    ]
    out = train.select(*keys).distinct().join(spike.groupBy(*keys).agg(F.max("overall_mean").alias("overall")), list(keys), "left").fillna(0.0, "overall")
    for df, at, values in tables:
        out = out.join(df.groupBy(*keys).agg(*(F.map_from_entries(F.collect_list(F.struct(F.col(at), F.col(v) if isinstance(v, str) else v))).alias(c) for c, v in values.items())), list(keys), "left")
    return out


#: Series that a task steps together.
TOGETHER = 256
_BANDS = ("y_raw", "p_spike", "y_p10", "y_pred", "y_p90")


def _table_of(maps: list[dict], name: str, size: int, none: float) -> np.ndarray:
    """One row for each series: a map's values at 0 to size - 1, none where it has none."""
    out = np.full((len(maps), size), none)
    for row, own in zip(out, maps, strict=True):
        for at, value in dict(own[name] if own[name] is not None else {}).items():
            if value is not None:
                row[int(at)] = value
    return out


class _Corrections:
    """adjust_forecast, step by step, for the maps of several series."""

    def __init__(self, maps: list[dict]):
        self.bias, self.floor, self.low, self.high = (_table_of(maps, c, 24, 0.0) for c in ("bias", "floor", "low", "high"))
        self.seasonal, self.share = (_table_of(maps, c, 168, 0.0) for c in ("seasonal", "p_spike"))
        overall = np.array([m["overall"] or 0.0 for m in maps])[:, None]
        spike = _table_of(maps, "spike", 24, np.nan)
        self.spike, self.rows = np.where(np.isnan(spike), overall, spike), np.arange(len(maps))

    def __call__(self, raw: np.ndarray, step: int, hours: np.ndarray, p: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(p_spike, low edge, prediction, high edge) of raw predictions; p, or else the share of spikes, tells spikes."""
        hour, weekday, _ = learn.calendar(hours, np.zeros(0, np.int64))
        at = lambda table, i: table[self.rows, i]
        cell = weekday * 24 + hour
        p = at(self.share, cell) if p is None else p
        busy, alpha, bias = (hour >= PEAK[0]) & (hour <= PEAK[1]) & (weekday < 5), min(0.4, step / 168 * 0.4), at(self.bias, hour)
        y = (1 - alpha) * raw + alpha * at(self.seasonal, cell)
        y, low, high = (np.maximum(0.0, x + bias) for x in (y, np.maximum(0.0, raw + at(self.low, hour)), np.maximum(0.0, raw + at(self.high, hour))))
        y, low, high = (np.where(busy, np.maximum(x, at(self.floor, hour)), x) for x in (y, low, high))
        hot = p >= 0.5
        y = np.where(hot & busy, 0.5 * y + 0.5 * at(self.spike, hour), y)
        half = (high - low) / 2 * 1.2
        low, high = np.where(hot, np.maximum(0.0, y - half), low), np.where(hot, y + half, high)
        half = (high - low) / 2 * max(1.0, ((step + 1) / 24) ** 0.5)
        return p, np.maximum(0.0, y - half), y, y + half


def recursive_forecast(
    h: DataFrame, periods: int = 48, keys: Sequence[str] = (), holidays: Sequence[str] = (), ridge: float = 1.0, buffer: int = 200, maps: DataFrame | None = None, extra: Sequence[str] = (),
    held: dict[str, float | None] | None = None, trees: int = 0, spike_trees: int = 0, short: str = "zero", return_pct: float | None = None,
) -> DataFrame:
    """(keys, ds, step, y_raw, p_spike, y_p10, y_pred, y_p90): each series' forecast, its own predictions
    fed back into lags and rolls.

    A series is hourly rows, 8,760 a year. Tasks take their series' rows in order, fit each one's model on calendar, lag and
    roll features (a ridge regression, or with trees so many boosted ones), and step up to TOGETHER series at once.
    Columns of h may be features too: `extra` ones are projected (see trend_tail), `held` ones keep the value given,
    or if that is None their last one. Predictions are at least 0. With maps (see series_maps; keys are needed)
    the steps of adjust_forecast are applied to each prediction before it is fed back, unrounded; without, y_pred is the
    bare prediction and both edges of its band. Spikes are told by spike_trees boosted trees of each series' own (y
    above its 75th percentile), or where that is 0 by the maps' share of the hour of the week. A lag before a series' start is 0;
    short="last" takes its last value. return_pct: return_to_work raises each prediction before it is fed back. A buffer under
    168 rows cuts the longest lag and mean. Null keys are a series; rows without a time don't count.
    """
    held = held or {}
    if maps is not None and not keys:
        raise ValueError("maps go by keys")
    free = np.array(sorted({np.datetime64(d, "D").astype(np.int64) for d in holidays}), np.int64)
    sides, kinds = [*extra, *held], dict(h.dtypes)
    names = [c for c in (maps.columns if maps is not None else []) if c not in keys]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "ds timestamp", "step int", ", ".join(f"{c} double" for c in _BANDS)])

    def fitted(pdf: pd.DataFrame):
        """(y, last hour, projected columns by step, weights or trees, spike trees) of a series."""
        y = pdf["report_count"].to_numpy(dtype=float)
        hours = learn.hours_of(pdf["timestamp_hour"])
        side = pdf[sides].astype(float).fillna(0.0).to_numpy().reshape(len(y), len(sides))
        first = learn.first_row(len(y))
        x = learn.series_features(y, hours, free, side, short, reach=buffer)[first:]
        model = learn.boost(x, y[first:], np.maximum(y[first:] ** 2 / max(float((y[first:] ** 2).mean()), 1e-9), 1.0), trees) if trees else learn.ridge(x, y[first:], ridge)
        spikes = learn.boost(x, (y[first:] > np.quantile(y, 0.75)).astype(float), trees=spike_trees, spikes=True) if spike_trees else None
        ahead = np.stack([learn.projected(side[:, i], periods) if c in extra else np.full(periods, side[-1, i] if held[c] is None else held[c]) for i, c in enumerate(sides)], axis=1) if sides else np.zeros((periods, 0))
        return y, hours[-1], ahead, model, spikes

    def stepped(group: list[pd.DataFrame]) -> pd.DataFrame:
        own = [fitted(g[g["timestamp_hour"].notna()]) for g in group]
        past, size = np.zeros((len(own), buffer)), np.array([min(buffer, len(o[0])) for o in own])
        for row, n, o in zip(past, size, own, strict=True):
            row[buffer - n :] = o[0][len(o[0]) - n :]
        last, ahead = np.array([o[1] for o in own]), np.stack([o[2] for o in own])
        told = learn.together([o[3] for o in own]) if trees else None
        weights = None if trees else np.stack([o[3] for o in own])
        spikes = learn.together([o[4] for o in own]) if spike_trees else None
        first_rows = [g.iloc[0] for g in group]
        has = np.array([bool(names) and isinstance(r["bias"], (dict, list)) for r in first_rows])
        adjust = _Corrections([{c: r[c] if ok else None for c in names} for r, ok in zip(first_rows, has, strict=True)]) if names else None
        out = np.empty((len(own), periods, len(_BANDS)))
        for step in range(periods):
            hours = last + step + 1
            x = learn.step_features(past, size, hours, free, ahead[:, step], short)
            raw = np.maximum(0.0, told(x) if trees else (x * weights).sum(axis=1))
            p = learn.odds(spikes(x)) if spike_trees else None
            bare = (np.zeros(len(own)) if p is None else p, raw, raw, raw)
            values = bare
            if adjust is not None:
                values = tuple(np.where(has, a, b) for a, b in zip(adjust(raw, step, hours, p), bare, strict=True))
            p, low, pred, high = values
            if return_pct is not None:
                today, before = (learn.calendar(t, free)[2] for t in (hours, hours - 24))
                low, pred, high = (v * np.where(~today & before, 1 + return_pct, 1.0) for v in (low, pred, high))
                low, high = np.minimum(low, pred), np.maximum(high, pred)
            out[:, step] = np.stack([raw, p, low, pred, high], axis=1)
            past = np.concatenate([past[:, 1:], pred[:, None]], axis=1)
            size = np.minimum(size + 1, buffer)
        table = {k: np.repeat(np.array([r[k] for r in first_rows], dtype=object), periods) for k in keys}
        table["ds"] = pd.to_datetime((np.repeat(last, periods) + np.tile(np.arange(1, periods + 1), len(own))) * 3600, unit="s")
        table["step"] = np.tile(np.arange(periods, dtype=np.int32), len(own))
        return pd.DataFrame(table | {c: out[:, :, i].ravel() for i, c in enumerate(_BANDS)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, ready = [], []  # the rows of the last series so far, and whole series
        for batch in batches:
            cuts = [0, *(np.flatnonzero(np.diff(pd.factorize(batch["__series"], use_na_sentinel=False)[0])) + 1).tolist(), len(batch)]
            for first, end in zip(cuts, cuts[1:], strict=False):
                rows = batch.iloc[first:end]
                if len(rows) and waiting and waiting[-1]["__series"].iloc[0] != rows["__series"].iloc[0]:
                    ready.append(pd.concat(waiting))
                    waiting = []
                waiting += [rows] if len(rows) else []
                if len(ready) >= TOGETHER:
                    yield from whole(ready)
                    ready = []
        yield from whole([*ready, *([pd.concat(waiting)] if waiting else [])])

    def whole(series: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series = [s for s in series if s["timestamp_hour"].notna().any()]  # maps of a series without rows
        if series:
            yield stepped(series)

    rows = h.filter("timestamp_hour is not null").select(*keys, "timestamp_hour", "report_count", *sides)
    if maps is not None:
        rows = rows.unionByName(maps, allowMissingColumns=True)
    rows = rows.withColumn("__series", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit(""))
    rows = rows.repartition("__series").sortWithinPartitions("__series", F.asc_nulls_first("timestamp_hour"))
    return rows.mapInPandas(run, schema)


def score_by_series(train: DataFrame, test: DataFrame, keys: Sequence[str], features: Sequence[str] = POINT_FEATURES, y: str = "report_count", trees: int = 40, depth: int = 3, rate: float = 0.2) -> DataFrame:
    """test with y_pred and p_spike of boosted trees that each series fits on its own rows of train.

    y_pred is the point forecast (rows weighted as by sample_weights), at least 0; p_spike the probability that y exceeds the
    train's 75th percentile. A series' rows meet in one task: hourly rows, 8,760 a year; all series are fitted in one
    shuffle. Null features count 0. A series without train rows gets nulls; test rows keep their columns.
    """
    cells, kept = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, c in enumerate(features)], test.columns
    known = train.filter(F.col(y).isNotNull()).select(*keys, F.col(y).cast("double").alias("__y"), *cells)
    asked = test.select(*kept, *cells)
    names = [f"__f{i}" for i in range(len(features))]

    def fit(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = asked[kept].assign(y_pred=None, p_spike=None)
        if len(known) and len(asked):
            x, y = known[names].to_numpy(dtype=float), known["__y"].to_numpy()
            weight = np.maximum(y**2 / max(float((y**2).mean()), 1e-9), 1.0)
            new = asked[names].to_numpy(dtype=float)
            out["y_pred"] = np.maximum(0.0, learn.boost(x, y, weight, trees, depth, rate)(new))
            out["p_spike"] = learn.odds(learn.boost(x, (y > np.quantile(y, 0.75)).astype(float), None, trees, depth, rate, spikes=True)(new))
        return out.astype({"y_pred": float, "p_spike": float})

    schema = ", ".join([*(f"`{c}` {t}" for c, t in test.dtypes), "y_pred double, p_spike double"])
    if not keys:
        known, asked, keys = known.withColumn("__all", F.lit(1)), asked.withColumn("__all", F.lit(1)), ["__all"]
    return known.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(fit, schema)


def return_to_work(forecast: DataFrame, holidays: DataFrame, pct: float = 0.1) -> DataFrame:
    """Forecasts of the first working day after a weekend day or holiday grow by pct; then p10 <= p50 <= p90, all >= 0."""
    free = holidays.select(F.col("date").alias("__free")).distinct()
    day = F.to_date("ds")
    df = forecast.join(F.broadcast(free), day == F.col("__free"), "left").withColumn("__today", F.col("__free").isNotNull() | (F.weekday("ds") >= 5)).drop("__free")
    df = df.join(F.broadcast(free), F.date_sub(day, 1) == F.col("__free"), "left").withColumn("__before", F.col("__free").isNotNull() | (F.weekday(F.date_sub(day, 1)) >= 5)).drop("__free")
    factor = F.when(~F.col("__today") & F.col("__before"), 1 + pct).otherwise(1.0)
    df = df.withColumns({c: positive(F.col(c) * factor) for c in ("y_p10", "y_pred", "y_p90")})
    return df.withColumns({"y_p10": F.least("y_p10", "y_pred"), "y_p90": F.greatest("y_p90", "y_pred")}).drop("__today", "__before")


def daily_rollup(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy(F.to_date("ds").alias("date")).agg(*(F.sum(c).alias(c) for c in ("y_p10", "y_pred", "y_p90")))


def capacity_kpis(daily: DataFrame, history: DataFrame) -> DataFrame:
    """Peak, stress peak (p90), mean, total; and against the history: change of the mean, its maximum and P90."""
    own = daily.agg(F.max("y_pred").alias("peak"), F.max("y_p90").alias("stress_peak"), F.avg("y_pred").alias("mean"), F.sum("y_pred").alias("total"))
    past = history.agg(F.avg("y").alias("__mean"), F.max("y").alias("history_max"), F.percentile("y", 0.9).alias("history_p90"))
    return own.crossJoin(past).withColumn("delta_pct", F.try_divide(F.col("mean") - F.col("__mean"), F.col("__mean")) * 100).drop("__mean")


def peak_days(daily: DataFrame, n: int = 3) -> DataFrame:
    return daily.orderBy(F.desc("y_pred"), "date").limit(n)


def structural_components(h: DataFrame, keys: Sequence[str] = (), width: int = 168) -> DataFrame:
    """(keys, date, trend, weekly, daily): centred moving average; means of what it leaves by weekday, and
    of what that leaves by hour; averaged by day."""
    window = W.partitionBy(*keys).orderBy("timestamp_hour").rowsBetween(-(width // 2), width // 2 - 1)
    df = h.select(*keys, "timestamp_hour", F.to_date("timestamp_hour").alias("date"), F.weekday("timestamp_hour").alias("__d"), F.hour("timestamp_hour").alias("__h"), "report_count", F.avg("report_count").over(window).alias("trend"))
    df = df.withColumn("weekly", F.avg(F.col("report_count") - F.col("trend")).over(W.partitionBy(*keys, "__d")))
    df = df.withColumn("daily", F.avg(F.col("report_count") - F.col("trend") - F.col("weekly")).over(W.partitionBy(*keys, "__h")))
    return df.groupBy(*keys, "date").agg(*(F.avg(c).alias(c) for c in ("trend", "weekly", "daily")))


def scenario(model, features: DataFrame, overrides: dict[str, float], names: Sequence[str] = POINT_FEATURES) -> DataFrame:
    """What the model says of the rows with some features replaced; absent features count 0."""
    df = features.withColumns({k: F.lit(float(v)) for k, v in overrides.items()})
    df = df.withColumns({k: F.lit(0.0) for k in names if k not in df.columns})
    return score_point_model(model, df, names)


def best_config(metrics: DataFrame, champion_mase: float) -> DataFrame:
    """The row of the least MASE (of ties the first configuration), and whether it is no worse than the champion."""
    return metrics.orderBy(F.asc_nulls_last("mase"), "config_index").limit(1).withColumn("promote", F.col("mase") <= champion_mase)
