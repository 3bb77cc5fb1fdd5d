"""The driver's tables as run, report and queue tables; nothing else knows their schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblore.operators.clean import add_time_features, quality_sanitize
from joblore.sources.runs import read_executions

EPOCH = "2024-01-01"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run, from `events`."""
    e = _table(spark, sf_dir, "events").withColumn("started_at", F.col("ts").cast("timestamp"))
    end = F.date_add(F.to_date(F.lit(EPOCH)), (F.col("event_id") % 90).cast("int"))
    iso = F.date_format(end, "yyyy-MM-dd")
    return e.select(
        F.col("event_id").alias("run_id"), "user_id", F.col("user_id").alias("report_id"),
        (F.col("started_at") - F.make_dt_interval(secs=((F.col("event_id") * 37) % 7200).cast("decimal(18,6)"))).alias("creation_date"), "started_at",
        F.when(F.col("event_id") % 97 != 0, F.timestamp_micros(F.unix_micros("started_at") + F.round(F.col("value") * 1000).cast("long") * 1000)).alias("completed_at"),
        (F.col("event_type") == "error").alias("failed"), ((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0)).alias("cancelled"),
        F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 10 == 0), "timeout").alias("error_message"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("startDate=2024-01-01&endDate="), iso))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"startDate": "2024-01-01", "endDate": "'), iso, F.lit('"}')))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("desde 01/01/2024 hasta "), F.date_format(end, "dd/MM/yyyy"))).alias("parameters"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per report, from `part`; names are padded."""
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("report_id"), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("report_name"), F.concat(F.lit("reports/"), "p_brand").alias("action_path"),
        (F.col("p_size") % 5).alias("queue_id"), F.when(F.col("p_partkey") % 20 == 0, "Yes").otherwise("0").alias("deprecated"),
        F.when(F.col("p_partkey") % 33 == 0, "TRUE").otherwise("n").alias("deleted"),
    )


def queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per queue, from `region`."""
    sizes = F.array(*map(F.lit, ("S", "M", "L", "XL", "XL")))
    return _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("queue_id"), F.col("r_name").alias("report_type"), F.element_at(sizes, F.col("r_regionkey") + 1).alias("report_size"))


def holidays(spark: SparkSession) -> DataFrame:
    """Fixture dates."""
    return spark.sql("SELECT explode(array(DATE'2024-01-01', DATE'2024-01-15')) AS date")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of report files, from `part`: (path, commit_ts, hash, author, message)."""
    p = _table(spark, sf_dir, "part")
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH), "yyyy-MM-dd") + (F.col("p_partkey") * 7919) % 2_592_000)
    return p.select(
        F.concat(F.lit("reports/"), "p_brand", F.when(F.col("p_partkey") % 2 == 0, ".sql").otherwise("")).alias("path"), ts.alias("commit_ts"),
        F.md5(F.col("p_partkey").cast("string")).alias("hash"), F.concat(F.lit("dev"), F.col("p_partkey") % 7).alias("author"), F.col("p_name").alias("message"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical input of every job."""
    return read_executions(runs(spark, sf_dir), reports(spark, sf_dir), queues(spark, sf_dir))


def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions with time features, of a duration between 0 and 6 hours."""
    return quality_sanitize(add_time_features(executions(spark, sf_dir)))
