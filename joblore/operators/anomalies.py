"""Anomalies of durations, and runs that were started twice."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.functions.columns import duration, robust_z, success
from joblore.operators.ordered import PIECE, with_halo


def _scored(df: DataFrame, min_score: float) -> DataFrame:
    out = df.filter(success() & (F.col("mad") > 0)).withColumn("score", robust_z(duration(), F.col("median"), F.col("mad")))
    return out.filter(F.col("score") > min_score)


def _baseline(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with median and mad by the keys, over all statuses.

    Percentiles are aggregated as counts of values, and durations are whole seconds under six hours,
    so a hot key stays small; the joins back may be split by adaptive execution.
    """
    df = df.join(df.groupBy(*keys).agg(F.percentile("duration_seconds", 0.5).alias("median")), list(keys))
    mad = df.groupBy(*keys).agg(F.percentile(F.abs(duration() - F.col("median")), 0.5).alias("mad"))
    return df.join(mad, list(keys))


def anomalies_global(df: DataFrame, min_score: float = 5) -> DataFrame:
    """Successful runs whose robust z against their report's median and MAD exceeds min_score."""
    return _scored(_baseline(df, ["report_name"]), min_score)


def _rolling(df: DataFrame, window: int, min_periods: int) -> DataFrame:
    """Rolling median and scale (interquartile range / 1.349) over the last `window` runs of a report, itself included.

    A report's runs are dealt in pieces that each know the runs before them, so a hot report is many tasks.
    """
    df = with_halo(df, ["report_name"], "started_at", ["started_at", "run_id"], window - 1, max(PIECE, window))
    frame = W.partitionBy("report_name", "__piece").orderBy("started_at", "run_id").rowsBetween(-window + 1, 0)
    enough = F.count("*").over(frame) >= min_periods
    df = df.withColumn("__q", F.when(enough, F.percentile("duration_seconds", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(frame)))
    return df.filter("__own").withColumns({"median": F.col("__q")[1], "mad": (F.col("__q")[2] - F.col("__q")[0]) / 1.349}).drop("__q", "__piece", "__own")


def anomalies_adaptive(df: DataFrame, window: int = 50, min_periods: int = 5, min_score: float = 5) -> DataFrame:
    """As anomalies_global, against the report's own recent runs."""
    return _scored(_rolling(df, window, min_periods), min_score)


def anomalies_contextual(df: DataFrame, min_score: float = 5) -> DataFrame:
    """As anomalies_global, by report and hour of day."""
    return _scored(_baseline(df, ["report_name", "hour"]), min_score)


def anomalies_contextual_adaptive(df: DataFrame, window: int = 30, min_periods: int = 5, min_score: float = 5) -> DataFrame:
    """As anomalies_adaptive with a shorter window."""
    return _scored(_rolling(df, window, min_periods), min_score)


def context_thresholds(df: DataFrame) -> DataFrame:
    """(report_name, hour, median, mad) of successful runs; a MAD of 0 becomes the mean MAD, or 1 if that is 0."""
    ok = df.filter(success())
    median = ok.groupBy("report_name", "hour").agg(F.percentile("duration_seconds", 0.5).alias("median"))
    mad = ok.join(median, ["report_name", "hour"]).groupBy("report_name", "hour").agg(F.first("median").alias("median"), F.percentile(F.abs(duration() - F.col("median")), 0.5).alias("mad"))
    mean = mad.agg(F.avg("mad").alias("__mean"))
    fallback = F.when(F.col("__mean") > 0, F.col("__mean")).otherwise(1.0)
    return mad.crossJoin(F.broadcast(mean)).withColumn("mad", F.when(F.col("mad") == 0, fallback).otherwise(F.col("mad"))).drop("__mean")


def threshold_exceptions(df: DataFrame, thresholds: DataFrame, z: float = 3.5) -> DataFrame:
    """Runs of any status that are further than z scaled MADs from their context's median, on either side."""
    out = df.join(thresholds, ["report_name", "hour"], "left")
    return out.withColumn("score", F.lit(0.6745) * F.abs(duration() - F.col("median")) / F.col("mad")).filter(F.col("score") > z)


def _grow(x: np.ndarray, rows: np.ndarray, depth: int, random: np.random.Generator) -> tuple:
    """An isolation tree: (feature, threshold, left, right), or the number of rows of a leaf."""
    low, high = x[rows].min(axis=0), x[rows].max(axis=0)
    split = np.flatnonzero(high > low)
    if depth == 0 or len(rows) < 2 or not len(split):
        return (len(rows),)
    f = int(random.choice(split))
    at = random.uniform(low[f], high[f])
    left = x[rows, f] < at
    return f, at, _grow(x, rows[left], depth - 1, random), _grow(x, rows[~left], depth - 1, random)


def _mean_path(n: float) -> float:
    """The mean depth of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(tree: tuple, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += depth + _mean_path(tree[0])
        return
    f, at, left, right = tree
    below = x[rows, f] < at
    _depths(left, x, rows[below], depth + 1, out)
    _depths(right, x, rows[~below], depth + 1, out)


def isolation_scores(df: DataFrame, features: Sequence[str] = ("duration_seconds", "hour", "weekday"), trees: int = 100, sample: int = 256, seed: int = 42, min_score: float | None = None) -> DataFrame:
    """df with score = 3 + 20 (anomaly - 0.5) of an isolation forest; nulls count 0, all statuses take part.

    The published algorithm's defaults: 100 trees of at most 256 rows each. The rows are drawn by a hash
    of run_id and collected (at most trees * sample of them); scoring runs where the data is.
    """
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    drawn = df.orderBy(F.xxhash64("run_id", F.lit(seed)), "run_id").limit(trees * sample).select(*x).toPandas().to_numpy()
    random = np.random.default_rng(seed)
    size = min(sample, len(drawn))
    forest = [_grow(drawn, random.choice(len(drawn), size, replace=False), int(np.ceil(np.log2(max(2, size)))), random) for _ in range(trees)] if size else []
    told = df.sparkSession.sparkContext.broadcast(forest)
    names, norm = list(features), max(_mean_path(size), 1e-9)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, depth = batch[names].astype(float).fillna(0.0).to_numpy(), np.zeros(len(batch))
            for tree in told.value:
                _depths(tree, rows, np.arange(len(rows)), 0, depth)
            anomaly = 2.0 ** (-depth / max(1, len(told.value)) / norm)
            yield batch.assign(score=3 + 20 * (anomaly - 0.5))

    keep = df.select("run_id", *x)
    out = keep.mapInPandas(score, ", ".join(f"{n} {t}" for n, t in keep.dtypes) + ", score double")
    return out if min_score is None else out.filter(F.col("score") > min_score)


def stretch_micros(threshold: float) -> int:
    """How long a stretch of time is: an hour, or twice the threshold."""
    return int(max(3600, 2 * (threshold + 1))) * 1_000_000


def stretches(start: Column, threshold: float) -> Column:
    """The numbers of the stretches of time that must know of a run's
    start: its own, and the next one if a run there may follow within threshold seconds."""
    micros, width = F.unix_micros(start), stretch_micros(threshold)
    own, last = F.floor(micros / width), F.floor((micros + int((threshold + 1) * 1_000_000)) / width)
    return F.when(own == last, F.array(own)).otherwise(F.array(own, last))


def double_runs(df: DataFrame, threshold: float = 60, match_params: bool = False, include_cancelled: bool = False) -> DataFrame:
    """Runs that started within threshold seconds (0 and it included) of the one before of the same report,
    and with match_params of the same parameters; null parameters are equal. Gaps are whole seconds.

    A report's runs are dealt by stretches of time; the runs at the end of one are known to the next too.
    """
    statuses = ["success", "cancelled"] if include_cancelled else ["success"]
    keys = ["report_name", *(["parameters"] if match_params else [])]
    order = W.partitionBy(*keys, "__stretch").orderBy("started_at", "run_id")
    df = df.filter(F.col("execution_status").isin(statuses)).withColumn("__stretch", F.explode(stretches(F.col("started_at"), threshold)))
    out = df.withColumns({"previous_run": F.lag("run_id").over(order), "previous_start": F.lag("started_at").over(order)})
    gap = F.floor((F.unix_micros("started_at") - F.unix_micros("previous_start")) / 1_000_000).cast("long")
    own = F.col("__stretch") == F.element_at(stretches(F.col("started_at"), threshold), 1)
    return out.withColumn("gap_seconds", gap).filter(own & F.col("gap_seconds").between(0, threshold)).drop("__stretch")


def double_run_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.count_distinct("report_name").alias("reports"), F.avg("gap_seconds").alias("mean_gap_seconds"))


def double_run_offenders(pairs: DataFrame, n: int = 15) -> DataFrame:
    return pairs.groupBy("report_name").agg(F.count("*").alias("pairs")).orderBy(F.desc("pairs"), "report_name").limit(n)


def label_quality(labels: DataFrame) -> DataFrame:
    """Precision, recall and F1 of labelled anomalies (verdict TP, FP, FN or TN); null without positives.
    Recall and F1 have the small terms 1e-4 and 1e-5 in their divisors."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    out = labels.agg(count("TP").alias("tp"), count("FP").alias("fp"), count("FN").alias("fn"))
    precision: Column = F.try_divide("tp", F.col("tp") + F.col("fp"))
    out = out.withColumns({"precision": precision, "recall": F.col("tp") / (F.col("tp") + F.col("fn") + 0.0001)})
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 0.00001))
