"""Cleaning, filters and derived columns of executions. All narrow, but for the removal of repeated runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts that stand for true.
TRUE_TEXTS = ("1", "true", "t", "yes", "y")


def truth(column: Column) -> Column:
    return F.coalesce(F.lower(column.cast("string")).isin(*TRUE_TEXTS), F.lit(False))


def derive_status(df: DataFrame) -> DataFrame:
    """execution_status: cancelled beats failed; an error message means failed."""
    failed = truth(F.col("failed")) | F.col("error_message").isNotNull()
    return df.withColumn("execution_status", F.when(truth(F.col("cancelled")), "cancelled").when(failed, "failed").otherwise("success"))


def derive_duration(df: DataFrame) -> DataFrame:
    """duration_seconds counts the second boundaries between start and end; duration_ms the milliseconds."""
    return df.withColumns(
        {
            "duration_seconds": F.unix_seconds("completed_at") - F.unix_seconds("started_at"),
            "duration_ms": F.unix_millis("completed_at") - F.unix_millis("started_at"),
        }
    )


def dedupe_runs(df: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run id: the one that started first; nulls last."""
    order = W.partitionBy(key).orderBy(F.col("started_at").asc_nulls_last(), F.xxhash64(*df.columns))
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def fill_missing_duration(df: DataFrame) -> DataFrame:
    """Null durations from the timestamps, in whole seconds."""
    seconds = F.floor((F.unix_millis("completed_at") - F.unix_millis("started_at")) / 1000).cast("long")
    return df.withColumn("duration_seconds", F.coalesce("duration_seconds", seconds))


def normalize_flags(df: DataFrame, columns: Sequence[str] = ("deprecated", "deleted")) -> DataFrame:
    """Texts and numbers as booleans; what isn't a true text, null included, is false."""
    return df.withColumns({c: truth(F.col(c)) for c in columns})


def add_time_features(df: DataFrame, ts: str = "started_at") -> DataFrame:
    """date, hour, weekday (0 is Monday)."""
    return df.withColumns({"date": F.to_date(ts), "hour": F.hour(ts), "weekday": F.weekday(ts)})


def add_calendar_flags(df: DataFrame, ts: str = "started_at") -> DataFrame:
    """time_hour, month_year, is_business_day (Monday to Friday), is_end_of_month."""
    return df.withColumns(
        {
            "time_hour": F.date_trunc("hour", ts), "month_year": F.trunc(F.to_date(ts), "month"), "is_business_day": F.weekday(ts) < 5,
            "is_end_of_month": F.to_date(ts) == F.last_day(ts),
        }
    )


def quality_sanitize(df: DataFrame, max_hours: float = 6) -> DataFrame:
    """Rows that started and took between 0 and max_hours, both excluded; casts are lenient."""
    df = df.withColumns({"duration_seconds": F.col("duration_seconds").try_cast("long"), "started_at": F.col("started_at").try_cast("timestamp")})
    return df.filter((F.col("duration_seconds") > 0) & (F.col("duration_seconds") < max_hours * 3600) & F.col("started_at").isNotNull())


def filter_date_range(df: DataFrame, start, end, ts: str = "started_at", end_exclusive_time: bool = False) -> DataFrame:
    """Calendar dates from start to end, inclusive; or, end_exclusive_time, up to midnight of end."""
    low = F.to_date(F.lit(start))
    if end_exclusive_time:
        return df.filter((F.col(ts) >= low) & (F.col(ts) <= F.to_date(F.lit(end)).cast("timestamp")))
    return df.filter(F.to_date(ts).between(low, F.to_date(F.lit(end))))


def apply_filters(df: DataFrame, dates: Sequence = (), types: Sequence[str] = (), statuses: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """All given restrictions; an empty one restricts nothing, and dates count only as a pair."""
    if len(dates) == 2:
        df = filter_date_range(df, *dates)
    for column, values in (("report_type", types), ("execution_status", statuses), ("report_name", names)):
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


def filter_options(df: DataFrame, limit: int = 200) -> DataFrame:
    """(kind, position, value): first and last date, sorted distinct types, and the names with most runs."""
    dates = df.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.lit("date").alias("kind"), F.posexplode(F.array("a", "b")).alias("position", "value"))
    types = df.select(F.lit("type").alias("kind"), F.col("report_type").alias("value")).filter("value is not null").distinct()
    types = types.withColumn("position", F.row_number().over(W.partitionBy("kind").orderBy("value")) - 1)
    top = df.filter("report_name is not null").groupBy(F.col("report_name").alias("value")).count().orderBy(F.desc("count"), "value").limit(limit)
    names = top.withColumn("kind", F.lit("name")).withColumn("position", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("count"), "value")) - 1)
    out = [x.select("kind", F.col("position").cast("int").alias("position"), F.col("value").cast("string").alias("value")) for x in (dates, types, names)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def anonymize_reports(df: DataFrame) -> DataFrame:
    """report_name becomes report_<id>, or report_unknown."""
    return df.withColumn("report_name", F.concat(F.lit("report_"), F.coalesce(F.col("report_id").cast("string"), F.lit("unknown"))))


def valid_executions(df: DataFrame) -> DataFrame:
    """Successful runs that took time, of reports that are neither deprecated nor deleted."""
    return df.filter((F.col("execution_status") == "success") & (F.col("duration_seconds") > 0) & ~truth(F.col("deprecated")) & ~truth(F.col("deleted")))


def drop_negative(df: DataFrame) -> DataFrame:
    return df.filter("duration_seconds >= 0")
