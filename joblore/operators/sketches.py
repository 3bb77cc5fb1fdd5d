"""Quantiles of durations from stored sketches: one row per report and day, merged for any span of days.

A sketch (KLL) of n durations keeps about 3 k of them, k being its accuracy: with k = 200 a quantile's rank is off by under 1.7 percent
with 99 percent confidence, merged or not, and up to k durations are kept whole. Windows read days, not runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblore.functions.columns import duration, robust_z, success

#: Accuracy of the sketches.
ACCURACY = 200
#: Quantiles by which a MAD is told.
RANKS = 301


def daily_sketches(df: DataFrame, keys: Sequence[str] = ("report_name",), k: int = ACCURACY) -> DataFrame:
    """(keys, date, runs, successes, failures, cancellations, ok_seconds, ok_sketch, all_sketch): a table to store, a day at a time.

    Sketches are of durations in seconds, of successful runs and of all; null where a day has none.
    """
    seconds = duration().cast("double")
    return df.groupBy(*keys, "date").agg(
        F.count("*").alias("runs"), F.count_if(success()).alias("successes"), F.count_if(F.col("execution_status") == "failed").alias("failures"), F.count_if(F.col("execution_status") == "cancelled").alias("cancellations"),
        F.sum(F.when(success(), duration())).alias("ok_seconds"), F.when(F.count(F.when(success(), seconds)) > 0, F.kll_sketch_agg_double(F.when(success(), seconds), k)).alias("ok_sketch"),
        F.when(F.count(seconds) > 0, F.kll_sketch_agg_double(seconds, k)).alias("all_sketch"),
    )


def _merged(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("runs", "successes", "failures", "cancellations", "ok_seconds")]
    sketches = [F.when(F.count(c) > 0, F.kll_merge_agg_double(c)).alias(c) for c in ("ok_sketch", "all_sketch")]
    return days.groupBy(*keys).agg(*sums, *sketches)


def quantile(sketch: str, q: float) -> Column:
    """A quantile of a sketch column; null of a null."""
    return F.when(F.col(sketch).isNotNull(), F.kll_sketch_get_quantile_double(sketch, F.lit(q)))


def features_of_days(days: DataFrame, keys: Sequence[str] = ("report_name",)) -> DataFrame:
    """The columns of report_features that days tell, over all days given; nulls are 0."""
    out = _merged(days, keys)
    out = out.withColumns({"mean_seconds": F.try_divide("ok_seconds", "successes"), "median_seconds": quantile("ok_sketch", 0.5), "p95_seconds": quantile("ok_sketch", 0.95)})
    out = out.withColumns({"failure_rate": F.col("failures") / F.col("runs"), "cancel_rate": F.col("cancellations") / F.col("runs"), "ok_seconds": F.coalesce("ok_seconds", F.lit(0))})
    return out.fillna(0.0, ["mean_seconds", "median_seconds", "p95_seconds"]).drop("ok_sketch", "all_sketch")


def drift_of_days(days: DataFrame, keys: Sequence[str] = ("report_name",), a: int = 7, b: int = 30) -> DataFrame:
    """quantile_drift of durations from days: the last a days given against the b before them."""
    last = days.agg(F.max("date").alias("__last"))
    back = F.datediff("__last", "date")
    tagged = days.crossJoin(F.broadcast(last)).withColumn("side", F.when(back < a, "A").when(back < a + b, "B"))
    sides = [_merged(tagged.filter(F.col("side") == s), keys).select(*keys, quantile("all_sketch", 0.5).alias(f"{s}_p50"), quantile("all_sketch", 0.9).alias(f"{s}_p90"), F.col("runs").alias(f"{s}_n")) for s in "AB"]
    out = sides[0].join(sides[1], list(keys))
    return out.withColumns({"delta_p50": F.col("A_p50") - F.col("B_p50"), "delta_p90": F.col("A_p90") - F.col("B_p90"), "ratio_p90": F.col("A_p90") / (F.col("B_p90") + 1e-9)})


def baseline_of_days(days: DataFrame, keys: Sequence[str] = ("report_name",)) -> DataFrame:
    """(keys, median, mad) of all durations: the MAD is the median distance of RANKS evenly spaced quantiles from the median."""
    out = _merged(days, keys).filter("all_sketch is not null").withColumn("median", quantile("all_sketch", 0.5))
    values = F.kll_sketch_get_quantile_double("all_sketch", F.array(*(F.lit((i + 0.5) / RANKS) for i in range(RANKS))))
    away = F.array_sort(F.transform(values, lambda x: F.abs(x - F.col("median"))))
    return out.select(*keys, "median", F.get(away, F.lit(RANKS // 2)).alias("mad"))


def anomalies_of_days(df: DataFrame, days: DataFrame, keys: Sequence[str] = ("report_name",), min_score: float = 5) -> DataFrame:
    """anomalies_global with the baseline of stored days: runs are only scored, in one pass."""
    out = df.join(baseline_of_days(days, keys), list(keys)).filter(success() & (F.col("mad") > 0))
    return out.withColumn("score", robust_z(duration(), F.col("median"), F.col("mad"))).filter(F.col("score") > min_score)
