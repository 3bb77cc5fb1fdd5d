"""Joins: dimensions, backlog, as-of, top keys, forecasts, changes before an anomaly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblore.operators.ordered import chunked, running


def join_dimensions(runs: DataFrame, reports: DataFrame, queues: DataFrame) -> DataFrame:
    """Runs with their report's and queue's columns, texts trimmed. Spark broadcasts a dimension if its
    size allows, and sorts and merges it otherwise."""
    reports = reports.withColumn("report_name", F.trim("report_name"))
    queues = queues.withColumns({"report_type": F.trim("report_type"), "report_size": F.trim("report_size")})
    return runs.join(reports, "report_id").join(queues, "queue_id")


def attach_backlog_to_runs(runs: DataFrame, hourly: DataFrame) -> DataFrame:
    """The backlog at the hour in which each run started; 0 where the series has none."""
    side = hourly.select(F.col("timestamp_hour").alias("__hour"), F.col("backlog").alias("__backlog"))
    out = runs.join(side, F.date_trunc("hour", "started_at") == F.col("__hour"), "left")
    return out.withColumn("backlog", F.coalesce("__backlog", F.lit(0))).drop("__hour", "__backlog")


def asof_backward(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """For each left row the values of the last right row with time <= its time (of ties the last by `tie`).

    One union, cut into hours of `on` (or intervals of a number): windows run within an hour, and the last values of
    the hours before are scanned over one row an hour and joined back (see ordered). Null times and null keys match nothing.
    """
    lefts = [c for c in left.columns if c not in by and c != on]
    side = F.struct(*(F.col(c) for c in values))
    both = left.select(*by, on, F.struct(*lefts).alias("__left") if lefts else F.lit(True).alias("__left"), F.lit(1).alias("__side"), F.lit(None).cast("string").alias("__tie"))
    right = right.dropna(subset=[*by, on]).select(*by, on, F.lit(0).alias("__side"), F.col(tie or on).cast("string").alias("__tie"), side.alias("__value"))
    both = chunked(both.unionByName(right, allowMissingColumns=True), on)
    out = running(both, by, [on, "__side", "__tie"], {"__last": "__value"}, last=True).filter("__side = 1")
    return out.select(*by, on, *(F.col(f"__left.{c}") for c in lefts), *(F.col(f"__last.{c}") for c in values))


def backlog_interval_count(runs: DataFrame, grid: DataFrame) -> DataFrame:
    """(timestamp_hour, backlog): runs with creation_date <= t < started_at, by a range join.

    A run waits on the hours of its own interval only: they are enumerated, then joined by equality.
    Runs that never started wait up to the last hour of the grid.
    """
    last = grid.agg(F.max("timestamp_hour").alias("__last"))
    first = F.when(F.col("creation_date") == F.date_trunc("hour", "creation_date"), F.col("creation_date")).otherwise(F.date_trunc("hour", "creation_date") + F.expr("interval 1 hour"))
    end = F.coalesce(F.col("started_at") - F.expr("interval 1 microsecond"), F.col("__last"))
    waits = runs.filter("creation_date is not null").crossJoin(F.broadcast(last)).withColumn("__first", first).withColumn("__end", end).filter("__first <= __end")
    waits = waits.select(F.explode(F.sequence("__first", "__end", F.expr("interval 1 hour"))).alias("timestamp_hour")).groupBy("timestamp_hour").agg(F.count("*").alias("backlog"))
    return grid.select("timestamp_hour").join(waits, "timestamp_hour", "left").select("timestamp_hour", F.coalesce("backlog", F.lit(0)).cast("long").alias("backlog"))


def backlog_running(runs: DataFrame, grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, timestamp_hour, backlog) by running sums of +1 at creation and -1 at start.

    Events are first summed into the first grid hour at or after them, so the running sum sees one
    row for each hour and key; it runs within months, and the sums of the months before are joined back.
    """
    up = lambda c: F.when(F.col(c) == F.date_trunc("hour", c), F.col(c)).otherwise(F.date_trunc("hour", c) + F.expr("interval 1 hour"))
    events = runs.select(*keys, up("creation_date").alias("timestamp_hour"), F.lit(1).alias("change")).unionByName(runs.select(*keys, up("started_at").alias("timestamp_hour"), F.lit(-1).alias("change")))
    events = events.filter("timestamp_hour is not null").groupBy(*keys, "timestamp_hour").agg(F.sum("change").alias("change"))
    both = grid.select(*keys, "timestamp_hour", F.lit(0).alias("change"), F.lit(1).alias("__grid")).unionByName(events.withColumn("__grid", F.lit(0)))
    both = both.withColumn("__month", F.date_trunc("month", "timestamp_hour"))
    out = running(both, keys, ["timestamp_hour", "__grid"], {"backlog": "change"}, levels=["__month"])
    return out.filter("__grid = 1").select(*keys, "timestamp_hour", F.col("backlog").cast("long").alias("backlog"))


def restrict_to_top(df: DataFrame, key: str, n: int = 50) -> DataFrame:
    """Rows whose key is among the n most frequent; ties by key. The keys are at most n rows."""
    top = df.filter(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count"), key).limit(n).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def join_forecast_actuals(forecast: DataFrame, actual: DataFrame, keys: Sequence[str] = (), ts: str = "ds") -> DataFrame:
    """Forecast and actual of the same time and keys, without rows that lack either."""
    return forecast.join(actual, [*keys, ts]).dropna(subset=["y_pred", "y_actual"])


def yoy_align(daily: DataFrame, horizon: DataFrame, shift_days: int = 364) -> DataFrame:
    """The horizon's dates with the value of the same weekday a year before, where there is one."""
    before = daily.select(F.date_add("date", shift_days).alias("date"), F.col("y").alias("y_last_year"))
    return horizon.join(before, "date", "left")


def holiday_flag(df: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    """is_holiday: 1 if the row's date is in the holiday table (a few dates a year, broadcast)."""
    table = holidays.select(F.col("date").alias("__holiday")).distinct()
    out = df.join(F.broadcast(table), F.to_date(date) == F.col("__holiday"), "left")
    return out.withColumn("is_holiday", F.col("__holiday").isNotNull().cast("int")).drop("__holiday")


def changes_before(anomalies: DataFrame, commits: DataFrame, limit: int = 5) -> DataFrame:
    """(run_id, rank, path, commit_ts, hash, author, message): the last changes of an anomaly's file.

    Slashes are normalised; the path itself, then its last parts, each with and without .sql, are
    tried in order, and the first candidate with any change at or before the start wins. Each change
    carries the last ones of its path up to itself, so a run takes those of one change.
    """
    clean = F.regexp_replace(F.replace(F.col("action_path"), F.lit("\\"), F.lit("/")), "^[./~]+", "")
    parts = F.split(clean, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    candidates = F.flatten(F.transform(tails, lambda p: F.array(p, F.concat(p, F.lit(".sql")))))
    tried = anomalies.select("run_id", "started_at", F.posexplode(candidates).alias("__at", "path"))
    last = W.partitionBy("path").orderBy("commit_ts", F.desc("hash")).rowsBetween(1 - limit, 0)
    known = commits.select("path", F.col("commit_ts").alias("__time"), F.lit(0).alias("__side"), "hash", F.collect_list(F.struct("commit_ts", "hash", "author", "message")).over(last).alias("__changes"))
    both = known.unionByName(tried.withColumnRenamed("started_at", "__time").withColumn("__side", F.lit(1)), allowMissingColumns=True)
    upto = W.partitionBy("path").orderBy("__time", "__side", F.desc("hash")).rowsBetween(W.unboundedPreceding, 0)
    hits = both.withColumn("__changes", F.last("__changes", ignorenulls=True).over(upto)).filter("__side = 1 and __changes is not null")
    best = hits.groupBy("run_id").agg(F.min(F.struct("__at", "path", "__changes")).alias("b"))
    out = best.select("run_id", F.col("b.path").alias("path"), F.posexplode(F.reverse("b.__changes")).alias("rank", "c"))
    return out.select("run_id", (F.col("rank") + 1).alias("rank"), "path", "c.commit_ts", "c.hash", "c.author", "c.message")
