"""Hourly load series and their features.

Windows run over hourly frames only: at most one row for each hour and series key, never over raw
runs, so even the series of all runs is 8,760 rows a year.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.functions.columns import positive
from joblore.operators.joins import asof_backward, backlog_running, holiday_flag
from joblore.operators.rollups import main_type_per_hour

LAGS = (1, 2, 3, 24, 168)
MEANS, STDS = (3, 24, 168), (3, 24)
LOGGED = ("y_lag_1", "y_lag_24", "y_lag_168", "y_rolling_mean_3", "y_rolling_mean_24", "y_rolling_mean_168")


def _by(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy("timestamp_hour")


def hourly_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("hour", "started_at").alias("timestamp_hour")).agg(F.count("*").alias("report_count"))


def fill_hours(hourly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every hour from a series' first to its last; missing ones count 0. Empty in, empty out."""
    span = hourly.groupBy(*keys).agg(F.min("timestamp_hour").alias("a"), F.max("timestamp_hour").alias("b")).filter("a is not null")
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("timestamp_hour"))
    return grid.join(hourly, [*keys, "timestamp_hour"], "left").select(*keys, "timestamp_hour", F.coalesce("report_count", F.lit(0)).alias("report_count"))


def calendar_features(h: DataFrame, holidays: DataFrame) -> DataFrame:
    """Hour, weekday, day, month and 0/1 flags; peak hours are 8 to 18, weekends weekday 5 and 6."""
    ts = F.col("timestamp_hour")
    h = holiday_flag(h, holidays, "timestamp_hour")
    h = h.withColumns(
        {
            "hour": F.hour(ts), "weekday": F.weekday(ts), "day_of_month": F.dayofmonth(ts), "month": F.month(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int"),
            "is_peak_hour": F.hour(ts).between(8, 18).cast("int"), "is_month_end": (F.to_date(ts) == F.last_day(ts)).cast("int"),
        }
    )
    return h.withColumns(
        {
            "weekend_x_peak": F.col("is_weekend") * F.col("is_peak_hour"), "holiday_x_peak": F.col("is_holiday") * F.col("is_peak_hour"),
            "weekend_or_holiday_x_peak": F.greatest("is_weekend", "is_holiday") * F.col("is_peak_hour"),
        }
    )


def _turn(x: Column, period: float) -> Column:
    return x * F.lit(2 * pi) / F.lit(float(period))


def cyclic_features(h: DataFrame) -> DataFrame:
    """Sine and cosine of hour, weekday and month."""
    parts = {"hour": (F.hour("timestamp_hour"), 24), "weekday": (F.weekday("timestamp_hour"), 7), "month": (F.month("timestamp_hour"), 12)}
    return h.withColumns({f"{name}_{f}": getattr(F, f)(_turn(x, p)) for name, (x, p) in parts.items() for f in ("sin", "cos")})


def fourier_features(h: DataFrame, keys: Sequence[str] = (), k: int = 3) -> DataFrame:
    """Sine and cosine of the first k harmonics of a day and a week; time is hours since the series' start."""
    if keys:
        h = h.withColumn("__start", F.min("timestamp_hour").over(W.partitionBy(*keys)))
    else:
        h = h.crossJoin(F.broadcast(h.agg(F.min("timestamp_hour").alias("__start"))))  # one row
    t = ((F.unix_seconds("timestamp_hour") - F.unix_seconds("__start")) / 3600).cast("double")
    return h.withColumns({f"fourier_{name}_{f}_{i}": getattr(F, f)(_turn(t * i, p)) for name, p in (("daily", 24), ("weekly", 168)) for i in range(1, k + 1) for f in ("sin", "cos")}).drop("__start")


def lag_features(h: DataFrame, keys: Sequence[str] = (), lags: Sequence[int] = LAGS, head: str = "zero") -> DataFrame:
    """y_lag_n; before the series' start 0 (head="zero") or null (head="drop", for rows to be dropped)."""
    fill = 0 if head == "zero" else None
    return h.withColumns({f"y_lag_{n}": F.lag("report_count", n, fill).over(_by(keys)) for n in lags})


def rolling_features(h: DataFrame, keys: Sequence[str] = (), head: str = "zero") -> DataFrame:
    """Means and deviations over the n rows before; null, or 0 for head="zero", where the window isn't
    whole. With head="zero" the lag before the series' start counts as a 0 of the first windows."""
    last = F.lag("report_count", 1, 0 if head == "zero" else None).over(_by(keys))
    h = h.withColumn("__last", last.cast("double"))
    out = {}
    for name, f, sizes in (("mean", F.avg, MEANS), ("std", F.stddev_samp, STDS)):
        for n in sizes:
            window = _by(keys).rowsBetween(-n + 1, 0)
            value = F.when(F.count("__last").over(window) == n, f("__last").over(window))
            out[f"y_rolling_{name}_{n}"] = F.coalesce(value, F.lit(0.0)) if head == "zero" else value
    return h.withColumns(out).drop("__last")


def log_features(h: DataFrame) -> DataFrame:
    return h.withColumns({f"log_{c}": F.log1p(positive(F.col(c).cast("double"))) for c in LOGGED})


#: Keys that name the start and the end of a date range in a parameter text, and what may follow them.
_START, _END, _GAP = r"(?i)(?:start_?date|fechainicio)", r"(?i)(?:end_?date|fechafin)", r"""[":\s=>]*["']?(\d{4}-\d{2}-\d{2})"""
_DATES = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}"


def _day(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))).cast("date")


def param_span_keyed(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, timestamp_hour, avg_param_span_days): days from the first start-like to the first end-like date, 0 to 3650."""
    span = F.datediff(_day(F.regexp_extract("parameters", _END + _GAP, 1)), _day(F.regexp_extract("parameters", _START + _GAP, 1)))
    rows = df.select(*keys, F.date_trunc("hour", "started_at").alias("timestamp_hour"), span.alias("span")).filter("span between 0 and 3650")
    return rows.groupBy(*keys, "timestamp_hour").agg(F.avg("span").alias("avg_param_span_days"))


def span_any(text: Column) -> Column:
    """Whole days between the least and greatest date of a text; 0 if it has under two."""
    days = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_DATES})"), 1), _day), lambda d: d.isNotNull())
    return F.coalesce(F.datediff(F.array_max(days), F.array_min(days)), F.lit(0))


def param_span_any(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, timestamp_hour, avg_param_span_days): the mean span_any of an hour's runs."""
    rows = df.select(*keys, F.date_trunc("hour", "started_at").alias("timestamp_hour"), span_any(F.col("parameters")).alias("span"))
    return rows.groupBy(*keys, "timestamp_hour").agg(F.avg("span").alias("avg_param_span_days"))


def factorize_type(h: DataFrame, label: str = "main_type") -> DataFrame:
    """Label map (label, id): codes by first appearance, ties by label; one row per label."""
    first = h.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min("timestamp_hour").alias("first"))
    return first.select(F.col(label).alias("label"), (F.row_number().over(W.orderBy("first", label)) - 1).alias("id"))


def enrich_hourly(h: DataFrame, runs: DataFrame, holidays: DataFrame, head: str = "zero", keys: Sequence[str] = ()) -> DataFrame:
    """The feature table of each series: calendar, cycles, lags, rolls, backlog, type code, parameter span.

    A series of a null key has no backlog to join and is left out.
    """
    at = [*keys, "timestamp_hour"]
    out = fourier_features(cyclic_features(calendar_features(h, holidays)), keys)
    out = log_features(rolling_features(lag_features(out, keys, head=head), keys, head=head))
    out = out.join(backlog_running(runs, h, keys), at)
    out = asof_backward(out, param_span_keyed(runs, keys), "timestamp_hour", ["avg_param_span_days"], keys)
    return out.withColumns({"avg_param_span_days": F.coalesce("avg_param_span_days", F.lit(0.0)), "tipo_reporte_id": F.lit(0)})


def prepare_training(runs: DataFrame, holidays: DataFrame, start=None, end=None, keys: Sequence[str] = ()) -> DataFrame:
    """Observed hours of each series only, with main type codes and spans; rows without whole windows are dropped.
    Type codes are the same in all series."""
    if start is not None:
        runs = runs.filter(F.to_date("started_at") >= F.to_date(F.lit(start)))
    if end is not None:
        runs = runs.filter(F.to_date("started_at") <= F.to_date(F.lit(end)))
    at, h, types = [*keys, "timestamp_hour"], hourly_counts(runs, keys), main_type_per_hour(runs, keys)
    out = fourier_features(cyclic_features(calendar_features(h, holidays)), keys)
    out = log_features(rolling_features(lag_features(out, keys, head="drop"), keys, head="drop"))
    out = out.join(types, at).join(F.broadcast(factorize_type(types)).withColumnRenamed("label", "main_type"), "main_type").withColumnRenamed("id", "tipo_reporte_id")
    out = out.join(backlog_running(runs, h, keys), at).join(param_span_any(runs, keys), at, "left").fillna(0.0, "avg_param_span_days")
    return out.dropna()


def moving_average(h: DataFrame, keys: Sequence[str] = (), hours: int = 24, tail_days: int = 7) -> DataFrame:
    """The last tail_days of each series with the mean of whole windows of `hours` rows."""
    last = h.groupBy(*keys).agg(F.max("timestamp_hour").alias("__last"))
    h = h.join(last, list(keys)) if keys else h.crossJoin(F.broadcast(last))
    h = h.filter(F.col("timestamp_hour") >= F.col("__last") - F.make_dt_interval(F.lit(tail_days))).drop("__last")
    window = _by(keys).rowsBetween(-hours + 1, 0)
    return h.withColumn("moving_average", F.when(F.count("*").over(window) == hours, F.avg("report_count").over(window)))


def tail_window(h: DataFrame, keys: Sequence[str] = (), hours: int = 168) -> DataFrame:
    """The last `hours` rows of each series."""
    order = W.partitionBy(*keys).orderBy(F.desc("timestamp_hour"))
    return h.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= hours).drop("__n")


def temporal_split(h: DataFrame, keys: Sequence[str] = (), ratio: float = 0.8) -> DataFrame:
    """split: train for the first int(n * ratio) rows of each series, test for the rest."""
    n = F.count("*").over(W.partitionBy(*keys))
    return h.withColumn("split", F.when(F.row_number().over(_by(keys)) <= F.floor(n * F.lit(ratio)), "train").otherwise("test"))


def naive_predictions(h: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """pred_last_hour and pred_last_week: the counts 1 and 168 rows before."""
    return h.withColumns({"pred_last_hour": F.lag("report_count", 1).over(_by(keys)), "pred_last_week": F.lag("report_count", 168).over(_by(keys))})
