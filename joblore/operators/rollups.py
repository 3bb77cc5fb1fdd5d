"""BI rollups of executions. Each is one aggregation by its own key, summed on the map side first;
every top list adds the name to its order, so that ties fall the same way each time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.functions.columns import duration, success
from joblore.operators.clean import add_calendar_flags


def kpis(df: DataFrame) -> DataFrame:
    """total_runs, mean_success_seconds, failure_rate_pct."""
    return df.agg(
        F.count("*").alias("total_runs"), F.avg(F.when(success(), duration())).alias("mean_success_seconds"),
        F.try_divide(F.count_if(F.col("execution_status") == "failed") * 100.0, F.count("*")).cast("double").alias("failure_rate_pct"),
    )


def median_of_mads(df: DataFrame) -> DataFrame:
    """The median over reports of the MAD of their successful durations."""
    ok = df.filter(success())
    median = ok.groupBy("report_name").agg(F.percentile("duration_seconds", 0.5).alias("median"))
    mad = ok.join(median, "report_name").groupBy("report_name").agg(F.percentile(F.abs(duration() - F.col("median")), 0.5).alias("mad"))
    return mad.agg(F.percentile("mad", 0.5).alias("median_of_mads"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, nulls), one row per column, from one scan."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.unpivot([], df.columns, "column_name", "nulls")


def data_window(df: DataFrame) -> DataFrame:
    return df.agg(F.min("started_at").alias("first_start"), F.max("started_at").alias("last_start"))


def trend_by_status(df: DataFrame) -> DataFrame:
    """(date, execution_status, runs) for each date and status that occur; 0 where they don't together."""
    counts = df.groupBy("date", "execution_status").agg(F.count("*").alias("runs"))
    statuses = counts.agg(F.collect_set("execution_status").alias("s"))
    grid = counts.select("date").distinct().crossJoin(F.broadcast(statuses)).select("date", F.explode("s").alias("execution_status"))
    return grid.join(counts, ["date", "execution_status"], "left").fillna(0, "runs")


def trend_breakdown(df: DataFrame, top_n: int = 10) -> DataFrame:
    """(date, execution_status, runs, breakdown): the reports with most runs, and how many more there are."""
    counts = df.groupBy("date", "execution_status", "report_name").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rn", F.row_number().over(W.partitionBy("date", "execution_status").orderBy(F.desc("n"), "report_name")))
    top = F.array_sort(F.collect_list(F.when(F.col("rn") <= top_n, F.struct("rn", "report_name", "n"))))
    out = ranked.groupBy("date", "execution_status").agg(F.sum("n").alias("runs"), top.alias("top"), F.count_if(F.col("rn") > top_n).alias("more"))
    text = F.array_join(F.transform("top", lambda x: F.concat(x["report_name"], F.lit(": "), x["n"].cast("string"))), ", ")
    return out.select("date", "execution_status", "runs", F.when(F.col("more") > 0, F.concat(text, F.lit(", "), F.col("more").cast("string"), F.lit(" more"))).otherwise(text).alias("breakdown"))


def slowest_reports(df: DataFrame, n: int = 10) -> DataFrame:
    return df.filter(success()).groupBy("report_name").agg(F.avg(duration()).alias("mean_seconds")).orderBy(F.desc("mean_seconds"), "report_name").limit(n)


def top_failures(df: DataFrame, n: int = 10) -> DataFrame:
    return df.filter("execution_status = 'failed'").groupBy("report_name").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "report_name").limit(n)


def duration_histogram(df: DataFrame, bin_seconds: int = 30) -> DataFrame:
    return df.filter(success()).groupBy((F.floor(duration() / bin_seconds) * bin_seconds).alias("bin_start")).agg(F.count("*").alias("runs"))


def hourly_load(df: DataFrame) -> DataFrame:
    return df.groupBy("hour").agg(F.count("*").alias("runs"))


def weekday_hour_heatmap(df: DataFrame) -> DataFrame:
    """A row for each weekday, 0 to 6, with the runs of each hour in h0 to h23."""
    counts = df.groupBy("weekday").pivot("hour", list(range(24))).count()
    days = df.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    out = days.join(counts, "weekday", "left")
    return out.select("weekday", *(F.coalesce(F.col(f"`{h}`"), F.lit(0)).alias(f"h{h}") for h in range(24)))


def day_hour_load(df: DataFrame) -> DataFrame:
    return df.groupBy("weekday", "hour").agg(F.count("*").alias("runs"))


def monthly_error(df: DataFrame) -> DataFrame:
    """(month_year, mae, rmse) of predicting each successful run by its report's mean."""
    ok = add_calendar_flags(df.filter(success())).select("month_year", "report_name", "duration_seconds")
    mean = ok.groupBy("report_name").agg(F.avg("duration_seconds").alias("prediction"))
    error = duration() - F.col("prediction")
    return ok.join(mean, "report_name").groupBy("month_year").agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))


def monthly_duration(df: DataFrame) -> DataFrame:
    return add_calendar_flags(df.filter(success())).groupBy("month_year", "report_name").agg(F.avg("duration_seconds").alias("mean_seconds"))


def critical_reports(df: DataFrame) -> DataFrame:
    """Which reports cost the most compute: runs, mean, total and deviation of successful durations."""
    out = df.filter(success()).groupBy("report_name").agg(
        F.count("*").alias("runs"), F.avg("duration_seconds").alias("mean_seconds"), F.sum("duration_seconds").alias("total_seconds"), F.stddev_samp("duration_seconds").alias("std_seconds")
    )
    return out.orderBy(F.desc("total_seconds"), "report_name")


def success_rate_by_type(df: DataFrame) -> DataFrame:
    out = df.groupBy("report_type").agg(F.count("*").alias("total"), F.count_if(success()).alias("ok"))
    return out.withColumn("success_rate", F.col("ok") * 100.0 / F.col("total"))


def impact_profile(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Per report of valid executions: runs, users, durations, share on business days and month ends.

    accuracy: percentiles by sketch with that accuracy, for keys of very many distinct durations.
    """
    pct = (lambda q: F.percentile("duration_seconds", q)) if accuracy is None else (lambda q: F.percentile_approx("duration_seconds", q, accuracy).cast("double"))
    out = add_calendar_flags(df).groupBy("report_name").agg(
        F.count("*").alias("runs"), F.count_distinct("user_id").alias("users"), F.avg("duration_seconds").alias("mean_seconds"), pct(0.5).alias("median_seconds"), pct(0.95).alias("p95_seconds"),
        F.sum("duration_seconds").alias("impact_score"), F.avg(F.col("is_business_day").cast("int")).alias("pct_business_day"),
        F.avg(F.col("is_end_of_month").cast("int")).alias("pct_end_of_month"), F.min("report_type").alias("report_type"), F.min("report_size").alias("report_size"),
    )
    return out.withColumn("variability_ratio", F.try_divide("p95_seconds", "median_seconds"))


def failure_analysis(df: DataFrame, min_attempts: int = 10) -> DataFrame:
    out = df.groupBy("report_name").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("execution_status") == "failed").alias("failures"), F.count_if(F.col("execution_status") == "cancelled").alias("cancellations")
    )
    return out.filter(F.col("attempts") >= min_attempts).withColumn("failure_rate_pct", (F.col("failures") + F.col("cancellations")) * 100.0 / F.col("attempts"))


def hourly_compute(df: DataFrame) -> DataFrame:
    return df.groupBy("hour").agg(F.count("*").alias("runs"), F.sum("duration_seconds").alias("compute_seconds"))


def report_features(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Per report and queue: runs by status; mean, median and p95 of successful durations; rates. Nulls are 0.

    accuracy: percentiles by sketch with that accuracy, as in impact_profile.
    """
    ok = F.when(success(), duration())
    pct = (lambda q: F.percentile(ok, q)) if accuracy is None else (lambda q: F.percentile_approx(ok, q, accuracy).cast("double"))
    out = df.groupBy("report_id", "report_name", "report_type", "queue_id").agg(
        F.count("*").alias("runs"), F.count_if(success()).alias("successes"), F.count_if(F.col("execution_status") == "failed").alias("failures"),
        F.count_if(F.col("execution_status") == "cancelled").alias("cancellations"), F.avg(ok).alias("mean_seconds"), pct(0.5).alias("median_seconds"), pct(0.95).alias("p95_seconds"),
    )
    return out.withColumns({"failure_rate": F.col("failures") / F.col("runs"), "cancel_rate": F.col("cancellations") / F.col("runs")}).fillna(0.0, ["mean_seconds", "median_seconds", "p95_seconds"])


def report_history(df: DataFrame, report: str) -> DataFrame:
    """The runs of a report, newest first, each with the report's totals."""
    own = df.filter(F.col("report_name") == report)
    totals = own.agg(F.count("*").alias("total_runs"), F.avg("duration_seconds").alias("mean_seconds"), F.count_if(F.col("execution_status") == "failed").alias("failures"))
    return own.select("run_id", "started_at", "duration_seconds", "execution_status").crossJoin(F.broadcast(totals)).orderBy(F.desc("started_at"), F.desc("run_id"))


def report_daily(df: DataFrame) -> DataFrame:
    return df.groupBy("report_name", "date").agg(F.avg("duration_seconds").alias("mean_seconds"), F.count("*").alias("runs"))


def series_summary(hourly: DataFrame) -> DataFrame:
    return hourly.agg(F.count("*").alias("hours"), F.sum("report_count").alias("total"), F.avg("report_count").alias("mean"), F.max("report_count").alias("max"))


def series_describe(hourly: DataFrame) -> DataFrame:
    y = F.col("report_count")
    quarter = lambda q: F.percentile(y, q)
    return hourly.agg(
        F.count(y).alias("count"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), quarter(0.25).alias("p25"), quarter(0.5).alias("p50"), quarter(0.75).alias("p75"), F.max(y).alias("max")
    )


def main_type_per_hour(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, timestamp_hour, main_type): the most frequent type of each hour; of ties the least."""
    return df.groupBy(*keys, F.date_trunc("hour", "started_at").alias("timestamp_hour")).agg(F.mode("report_type", True).alias("main_type"))
