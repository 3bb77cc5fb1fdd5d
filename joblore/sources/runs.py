"""Reading run logs and hourly series; writing extracts and calibration maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblore.operators.clean import derive_duration, derive_status
from joblore.operators.joins import join_dimensions

#: What every job reads.
EXECUTION_COLUMNS = [
    "run_id", "user_id", "creation_date", "started_at", "completed_at", "duration_seconds", "execution_status", "report_id", "report_name", "report_type",
    "report_size", "queue_id", "action_path", "parameters", "deprecated", "deleted",
]
RUNS_CSV = "run_id STRING, report_name STRING, report_type STRING, creation_date STRING, started_at STRING, completed_at STRING, parameters STRING"


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 64, **options: str) -> DataFrame:
    """A database table, read in ranges of its key by as many tasks; filters are pushed down."""
    ranges = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranges, **options).load()


def read_executions(runs: DataFrame, reports: DataFrame, queues: DataFrame, start=None, end=None) -> DataFrame:
    """Runs joined to their report and queue, in the canonical schema.

    start and end bound started_at by calendar date, inclusive. Runs without a report or queue go.
    """
    if start is not None:
        runs = runs.filter(F.to_date("started_at") >= F.to_date(F.lit(start)))
    if end is not None:
        runs = runs.filter(F.to_date("started_at") <= F.to_date(F.lit(end)))
    return derive_status(derive_duration(join_dimensions(runs, reports, queues))).select(EXECUTION_COLUMNS)


def lenient_timestamp(text: Column) -> Column:
    """A timestamp with or without fraction of a second; null if it can't be read."""
    tries = [F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")]
    return F.coalesce(*tries, F.try_to_timestamp(text))


def read_runs_csv(spark: SparkSession, path: str, schema: str = RUNS_CSV) -> DataFrame:
    """Runs of a CSV extract with a header; fields that can't be read become null."""
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return rows.withColumns({c: lenient_timestamp(F.col(c)) for c in ("creation_date", "started_at", "completed_at")})


def read_hourly_csv(spark: SparkSession, path: str, ts_col: str = "timestamp_hour", y_col: str = "report_count") -> DataFrame:
    """(timestamp_hour, report_count) of a CSV file; a missing count is 0, rows without a time go."""
    rows = spark.read.csv(path, header=True)
    if missing := {ts_col, y_col} - set(rows.columns):
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    out = rows.select(lenient_timestamp(F.col(ts_col)).alias("timestamp_hour"), F.coalesce(F.col(y_col).try_cast("double"), F.lit(0.0)).alias("report_count"))
    return out.filter("timestamp_hour is not null")


def write_extracts(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Write named result tables, each to its own folder, replacing what is there."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite").format(form)
        (writer.option("header", True) if form == "csv" else writer).save(f"{folder}/{name}")


def write_hour_map(table: DataFrame, path: str) -> None:
    """Persist (hour, value) as JSON lines."""
    table.select("hour", "value").write.mode("overwrite").json(path)


def read_hour_map(spark: SparkSession, path: str, correction: bool = False) -> DataFrame:
    """(hour, value). A correction map whose values are all positive with a median over 0.5 is an old
    multiplicative one; it is read as empty."""
    table = spark.read.schema("hour INT, value DOUBLE").json(path)
    if correction:
        old = table.agg((F.min("value") > 0).alias("positive"), (F.median("value") > 0.5).alias("large"))
        table = table.crossJoin(F.broadcast(old)).filter(~(F.coalesce("positive", F.lit(False)) & F.coalesce("large", F.lit(False)))).drop("positive", "large")
    return table
