"""Evaluation of forecasts: errors, hold-outs, backtests, bands, hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.operators.joins import join_forecast_actuals
from joblore.operators.ordered import running
from joblore.operators.series import naive_predictions

#: Counts above this are high volume.
HIGH_VOLUME = 50


def _mae(y, p):
    return F.avg(F.abs(F.col(y) - F.col(p)))


def _rmse(y, p):
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), F.lit(2))))


def _bias_high(y, p):
    return F.coalesce(F.avg(F.when(F.col(y) > HIGH_VOLUME, F.col(p) - F.col(y))), F.lit(0.0))


def error_metrics(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, mae, rmse) over pairs without nulls; null errors when there are none."""
    pairs = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), _mae(y, pred).alias("mae"), _rmse(y, pred).alias("rmse"))


def baseline_metrics(h: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """error_metrics of the last hour and of the hour a week before; `rows` counts all hours."""
    pred = naive_predictions(h, keys)
    pairs = pred.select(*keys, "report_count", F.explode(F.create_map(F.lit("last_hour"), F.col("pred_last_hour"), F.lit("last_week"), F.col("pred_last_week"))).alias("baseline", "pred"))
    out = pairs.groupBy(*keys, "baseline").agg(F.count("*").alias("rows"), F.count("pred").alias("n"), _mae("report_count", "pred").alias("mae"), _rmse("report_count", "pred").alias("rmse"))
    return out


def mase(train: DataFrame, test: DataFrame, y: str, pred: str, ts: str = "timestamp_hour", m: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mae, naive, mase): test MAE over the train's mean |y_t - y_(t-m)|; null if train has <= m rows or that is 0."""
    before = F.lag(y, m).over(W.partitionBy(*keys).orderBy(ts))
    naive = train.select(*keys, F.abs(F.col(y) - before).alias("d")).groupBy(*keys).agg(F.avg("d").alias("naive"))
    own = test.groupBy(*keys).agg(_mae(y, pred).alias("mae"))
    both = own.join(naive, list(keys), "left") if keys else own.crossJoin(naive)
    return both.select(*keys, "mae", "naive", F.when(F.col("naive") > 0, F.col("mae") / F.col("naive")).alias("mase"))


def holdout_report(df: DataFrame, y: str = "report_count", pred: str = "y_pred", split: str = "split", ts: str = "timestamp_hour", keys: Sequence[str] = ()) -> DataFrame:
    """Per key: errors of the test rows, of the naive forecast (the row before, across the split), MASE and improvement."""
    df = df.withColumn("__before", F.lag(y).over(W.partitionBy(*keys).orderBy(ts)).cast("double"))
    train, test = F.col(split) == "train", F.col(split) == "test"
    df = df.withColumns({"__mean": F.avg(F.when(train, F.col(y))).over(W.partitionBy(*keys)), "__y": F.col(y).cast("double")})
    on = lambda x: F.when(test, x)
    gap, naive = F.col("__y") - F.col(pred), F.col("__y") - F.col("__before")
    out = df.groupBy(*keys).agg(
        F.count_if(test).alias("n_test"), F.avg(on(F.abs(gap))).alias("mae"), F.sqrt(F.avg(on(gap * gap))).alias("rmse"), F.avg(on(F.abs(naive))).alias("naive_mae"), F.sqrt(F.avg(on(naive * naive))).alias("naive_rmse"),
        F.avg(F.when(train, F.abs(naive))).alias("__divisor"), F.avg(F.when(train, F.abs(F.col("__y") - F.col("__mean")))).alias("__spread"),
        F.coalesce(F.avg(F.when(test & (F.col("__y") > HIGH_VOLUME), -gap)), F.lit(0.0)).alias("high_volume_bias"),
    )
    divisor = F.when(F.col("__divisor") < 1e-8, F.col("__spread") + 1e-8).otherwise(F.col("__divisor"))
    return out.withColumns({"mase": F.col("mae") / divisor, "improvement_pct": F.try_divide(F.col("naive_mae") - F.col("mae"), F.col("naive_mae")) * 100}).drop("__divisor", "__spread")


def spike_metrics(test: DataFrame, y: str = "report_count", pred: str = "y_pred", naive: str = "pred_last_hour") -> DataFrame:
    """MAE of the model and of the naive forecast where y is over the test's 75th percentile."""
    p75 = test.agg(F.percentile(y, 0.75).alias("threshold"))
    return test.crossJoin(F.broadcast(p75)).filter(F.col(y) > F.col("threshold")).agg(F.count("*").alias("n"), _mae(y, pred).alias("spike_mae"), _mae(y, naive).alias("spike_mae_naive"))


def band_coverage(df: DataFrame, y: str = "y_actual", low: str = "y_p10", high: str = "y_p90") -> DataFrame:
    inside = F.col(y).between(F.col(low), F.col(high)).cast("int")
    return df.agg((F.avg(inside) * 100).alias("coverage_pct"), F.avg(F.col(high) - F.col(low)).alias("mean_width"))


def horizon_eval(forecast: DataFrame, actual: DataFrame, keys: Sequence[str] = (), least: int = 24) -> DataFrame:
    """Per key: n, mae, rmse, bias, high_volume_bias, coverage_pct of the matched hours; none under `least` of them."""
    j = join_forecast_actuals(forecast, actual, keys)
    inside = F.col("y_actual").between(F.col("y_p10"), F.col("y_p90")).cast("int")
    out = j.groupBy(*keys).agg(
        F.count("*").alias("n"), _mae("y_actual", "y_pred").alias("mae"), _rmse("y_actual", "y_pred").alias("rmse"), F.avg(F.col("y_pred") - F.col("y_actual")).alias("bias"),
        _bias_high("y_actual", "y_pred").alias("high_volume_bias"), (F.avg(inside) * 100).alias("coverage_pct"),
    )
    return out.filter(F.col("n") >= least)


def residuals(df: DataFrame, y: str, pred: str) -> DataFrame:
    """df with residual = y - pred; the pairs (pred, residual) show whether the error depends on the level."""
    return df.withColumn("residual", (F.col(y) - F.col(pred)).cast("double"))


def residual_histogram(df: DataFrame, y: str, pred: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): residuals y - pred in equal widths from the least to the greatest."""
    res = residuals(df, y, pred).select(F.col("residual").alias("r")).filter("r is not null")
    span = res.agg(F.min("r").alias("a"), F.max("r").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    place = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("r") - F.col("a")) / width), F.lit(bins - 1))).otherwise(0)
    out = res.crossJoin(F.broadcast(span)).groupBy(place.cast("int").alias("bin"), "a", "b").agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n")


def acf(df: DataFrame, value: str, ts: str = "timestamp_hour", max_lag: int = 24, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, lag, acf): correlation of each value with the one `lag` rows before; none if the variance is 0."""
    order = W.partitionBy(*keys).orderBy(ts)
    lags = df.select(*keys, F.col(value).cast("double").alias("x"), *(F.lag(value, k).over(order).cast("double").alias(f"l{k}") for k in range(1, max_lag + 1)))
    out = lags.groupBy(*keys).agg(F.var_pop("x").alias("v"), *(F.corr("x", f"l{k}").alias(str(k)) for k in range(1, max_lag + 1))).filter("v > 0").drop("v")
    out = out.unpivot(list(keys), [str(k) for k in range(1, max_lag + 1)], "lag", "acf")
    return out.select(*keys, F.col("lag").cast("int").alias("lag"), "acf")


def walk_forward_folds(h: DataFrame, n: int = 5, ts: str = "timestamp_hour", keys: Sequence[str] = ()) -> DataFrame:
    """Each series (keys) of h repeated for each expanding fold, with fold and part (train or test); each test has rows // (n + 1) rows.

    Fold numbers are data: n rows of a table join the series, so all folds are evaluated at once.
    """
    h = h.withColumns({"__i": F.row_number().over(W.partitionBy(*keys).orderBy(ts)) - 1, "__n": F.count("*").over(W.partitionBy(*keys))})
    folds = h.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n))))
    size = F.floor(F.col("__n") / (n + 1))
    start = F.col("__n") - (n - F.col("fold") + 1) * size
    return folds.withColumn("part", F.when(F.col("__i") < start, "train").when(F.col("__i") < start + size, "test")).filter("part is not null").drop("__i", "__n")


def walk_forward_eval(h: DataFrame, y: str = "report_count", pred: str = "pred_last_hour", n: int = 5, ts: str = "timestamp_hour", keys: Sequence[str] = ()) -> DataFrame:
    """Per series (keys) and fold mae and mase (divisor: the fold's naive error, or the whole series'), with mean and deviation over folds."""
    before, every = F.lag(y).over(W.partitionBy(*keys).orderBy(ts)), W.partitionBy(*keys)
    h = h.withColumn("__step", F.abs(F.col(y) - before)).withColumn("__all", F.avg("__step").over(every))
    h = h.withColumn("__mean", F.avg(y).over(every))
    out = walk_forward_folds(h, n, ts, keys).groupBy(*keys, "fold").agg(
        F.avg(F.when(F.col("part") == "test", F.abs(F.col(y) - F.col(pred)))).alias("mae"), F.avg(F.when(F.col("part") == "train", F.col("__step"))).alias("naive"), F.first("__all").alias("a"), F.first("__mean").alias("m")
    )
    whole = F.when(F.col("a") < 1e-8, F.col("m") + 1e-8).otherwise(F.col("a"))
    out = out.withColumn("mase", F.col("mae") / F.when(F.col("naive") > 1e-8, F.col("naive")).otherwise(whole))
    return out.select(*keys, "fold", "mae", "mase", F.avg("mae").over(every).alias("mae_mean"), F.stddev_pop("mae").over(every).alias("mae_std"), F.avg("mase").over(every).alias("mase_mean"), F.stddev_pop("mase").over(every).alias("mase_std"))


def rolling_origin(h: DataFrame, y: str = "report_count", initial: int = 336, period: int = 72, horizon: int = 24, season: int = 24, ts: str = "timestamp_hour", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step, n, mae, rmse) of a seasonal naive forecast made at each cut-off, by hours ahead.

    Cut-offs lie every `period` hours after the first `initial` ones, as long as a whole horizon follows.
    A cut-off is joined to the hours it predicts and to the last season before it by equality.
    """
    rows = h.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy(ts)).alias("i"), F.col(y).cast("double").alias("y"))
    count = rows.groupBy(*keys).agg(F.max("i").alias("n"))
    last = F.col("n") - horizon
    cuts = count.filter(last >= initial).select(*keys, F.explode(F.sequence(F.lit(initial).cast("int"), last.cast("int"), F.lit(period).cast("int"))).alias("cut"))
    ahead = cuts.select(*keys, "cut", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    ahead = ahead.select(*keys, "step", (F.col("cut") + F.col("step")).alias("i"), (F.col("cut") - season + 1 + (F.col("step") - 1) % season).alias("j"))
    pred = rows.select(*keys, F.col("i").alias("j"), F.col("y").alias("pred"))
    return ahead.join(rows, [*keys, "i"]).join(pred, [*keys, "j"]).groupBy(*keys, "step").agg(F.count("*").alias("n"), _mae("y", "pred").alias("mae"), _rmse("y", "pred").alias("rmse"))


def hit_labels(df: DataFrame, y: str, preds: Sequence[str], threshold: float = 30) -> DataFrame:
    """Long form (model, y, pred, hit, score): hit if |error| < threshold; score = 1 - |error| / greatest error of all models."""
    long = df.select(F.col(y).alias("y"), F.explode(F.create_map(*(x for p in preds for x in (F.lit(p), F.col(p).cast("double"))))).alias("model", "pred")).filter("y is not null and pred is not null")
    long = long.withColumn("error", F.abs(F.col("y") - F.col("pred")))
    top = long.agg(F.max("error").alias("top"))
    out = long.crossJoin(F.broadcast(top)).withColumn("score", F.when(F.col("top") > 0, 1 - F.col("error") / F.col("top")).otherwise(1.0))
    return out.select("model", "y", "pred", (F.col("error") < threshold).cast("int").alias("hit"), "score")


#: Intervals that the distinct scores of a curve are cut into.
INTERVALS = 64


def _by_score(df: DataFrame, score: str) -> DataFrame:
    """df with __chunk: of all scores, the interval of about equal counts that a row's is in, the greatest first."""
    cuts = df.agg(F.percentile_approx(F.col(score).cast("double"), F.array(*(F.lit(i / INTERVALS) for i in range(1, INTERVALS))), 1000).alias("__cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("__chunk", F.size(F.filter("__cuts", lambda c: c > F.col(score)))).drop("__cuts")


def roc_curve(df: DataFrame, label: str = "hit", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, score, tpr, fpr) at each distinct score, from the greatest down; rows are counted by score first, then
    summed within intervals of scores, with the sums of the intervals before joined back."""
    counts = df.groupBy(*keys, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    whole = counts.groupBy(*keys).agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    out = running(_by_score(counts, score), keys, [-F.col(score)], {"__ps": "p", "__ns": "n"}, levels=["__chunk"])
    same = [F.col(k).eqNullSafe(F.col(f"__w{i}")) for i, k in enumerate(keys)]
    whole = whole.withColumnsRenamed({k: f"__w{i}" for i, k in enumerate(keys)})
    out = out.join(F.broadcast(whole), same) if keys else out.crossJoin(F.broadcast(whole))
    return out.select(*keys, score, F.try_divide("__ps", "__p").alias("tpr"), F.try_divide("__ns", "__n").alias("fpr"))


def auc(roc: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, auc) by trapezoids; null if a class is missing."""
    share = F.coalesce("tpr", F.lit(0.0)) + F.coalesce("fpr", F.lit(0.0))  # it grows along the curve, so it cuts it into intervals
    points = roc.withColumns({"__at": F.struct("fpr", "tpr"), "__chunk": F.floor(share * (INTERVALS // 2))})
    points = running(points, keys, [-F.col(score)], {"__last": "__at"}, last=True, levels=["__chunk"], inclusive=False)
    x, y = (f(F.col(c), F.coalesce(F.col(f"__last.{c}"), F.lit(0.0))) for c, f in (("fpr", lambda a, b: a - b), ("tpr", lambda a, b: a + b)))
    return points.select(*keys, (x * y / 2).alias("area")).groupBy(*keys).agg(F.sum("area").alias("auc"))


def confusion(df: DataFrame, label: str = "hit", score: str = "score", cut: float = 0.5) -> DataFrame:
    """(actual, predicted, n) for all four cells."""
    counts = df.groupBy(F.col(label).cast("int").alias("actual"), (F.col(score) >= cut).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(4).select((F.col("id") / 2).cast("int").alias("actual"), (F.col("id") % 2).cast("int").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, "n")


def class_report(df: DataFrame, keys: Sequence[str] = ("model",), label: str = "hit", score: str = "score", cut: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of the positive class; 0 where undefined."""
    pred, true = F.col(score) >= cut, F.col(label) == 1
    out = df.groupBy(*keys).agg(F.count_if(pred & true).alias("tp"), F.count_if(pred & ~true).alias("fp"), F.count_if(~pred & true).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
