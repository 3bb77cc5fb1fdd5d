"""A database read in ranges, and quantiles from stored sketches."""

import datetime as dt
import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from joblore.operators import anomalies, drift, rollups, sketches
from joblore.plans import catalog
from joblore.sources import adapter, runs
from tests.test_cleaning_and_series import at, frame

SF = "/root/testdata/sf0.001"


def test_a_database_is_read_in_ranges_with_filters_pushed(spark):
    """Derby, which comes with Spark, holds the three tables; what is read of it is what the files give."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    tables = {"runs": adapter.runs(spark, SF), "reports": adapter.reports(spark, SF), "queues": adapter.queues(spark, SF)}
    for name, df in tables.items():
        df = df.withColumns({c: F.col(c).cast("int") for c, t in df.dtypes if t == "boolean"})  # Derby's booleans are not Spark's
        texts = ", ".join(f"{c} VARCHAR(200)" for c, t in df.dtypes if t == "string" and c not in ("error_message", "parameters"))  # those with nulls are CLOBs
        writer = df.repartition(1).write.option("driver", driver)
        (writer.option("createTableColumnTypes", texts) if texts else writer).jdbc(url, name)
    own = runs.read_jdbc(spark, url, "runs", "RUN_ID", 0, tables["runs"].count(), parts=5, driver=driver)
    assert own.rdd.getNumPartitions() == 5
    some = own.filter((F.col("RUN_ID") >= 100) & (F.col("RUN_ID") < 300))
    plan = some._jdf.queryExecution().executedPlan().toString().lower()
    assert "pushedfilters: [" in plan and "greaterthanorequal(run_id,100)" in plan and "lessthan(run_id,300)" in plan
    assert sorted(r[0] for r in some.collect()) == sorted(r.run_id for r in tables["runs"].filter("run_id >= 100 and run_id < 300").collect())
    sides = [spark.read.format("jdbc").options(url=url, dbtable=name, driver=driver).load() for name in ("reports", "queues")]
    lower = lambda df: df.withColumnsRenamed({c: c.lower() for c in df.columns})
    got = runs.read_executions(lower(own).withColumns({c: F.col(c).cast("boolean") for c in ("failed", "cancelled")}), *map(lower, sides))
    expected = adapter.executions(spark, SF)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(got) == order(expected) and got.count() > 0


def test_sketched_percentiles(spark):
    """accuracy= gives the nearest rank within its bound; exact without."""
    df = frame(spark, [(i, "a", "success", 1 + i, at("2024-01-01")) for i in range(4000)]).withColumns({"report_id": F.lit(1), "queue_id": F.lit(1)})
    exact, near = rollups.report_features(df).first(), rollups.report_features(df, accuracy=200).first()
    assert exact.median_seconds == 2000.5 and abs(near.median_seconds - 2000) <= 4000 / 200 and abs(near.p95_seconds - 3800) <= 4000 / 200
    assert near.runs == 4000


def test_days_of_sketches_against_runs(spark):
    random.seed(1)
    r = np.random.default_rng(1)
    rows = [(i, f"r{i % 3}", "success" if i % 7 else "failed", int(np.exp(r.normal(5, 1))) + 1, at("2024-02-10") - dt.timedelta(days=random.randint(0, 50), seconds=random.randint(1, 80_000))) for i in range(30_000)]
    rows += [(90_000, "only failed", "failed", 5, at("2024-02-09")), (90_001, "no duration", "failed", None, at("2024-02-09"))]
    df = frame(spark, rows).cache()
    days = sketches.daily_sketches(df).cache()
    assert days.groupBy("report_name", "date").count().filter("count > 1").count() == 0
    got = {x.report_name: x for x in sketches.features_of_days(days).collect()}
    for name in ("r0", "r1", "r2"):
        own = np.sort([x[3] for x in rows if x[1] == name and x[2] == "success"])
        for value, q in ((got[name].median_seconds, 0.5), (got[name].p95_seconds, 0.95)):
            ranks = np.searchsorted(own, [value, value], "left")[0] / len(own), np.searchsorted(own, value, "right") / len(own)
            assert ranks[0] - 0.02 <= q <= ranks[1] + 0.02
        assert got[name].runs == 10_000 and got[name].mean_seconds == own.mean()
    assert (got["only failed"].median_seconds, got["only failed"].failure_rate, got["no duration"].p95_seconds) == (0.0, 1.0, 0.0)
    exact = {x.report_name: x for x in drift.quantile_drift(df.filter("duration_seconds is not null"), keys=["report_name"]).collect()}
    near = {x.report_name: x for x in sketches.drift_of_days(days).collect()}
    for name in ("r0", "r1", "r2"):
        assert (near[name].A_n, near[name].B_n) == (exact[name].A_n, exact[name].B_n) and abs(near[name].A_p50 / exact[name].A_p50 - 1) < 0.1 and abs(near[name].ratio_p90 / exact[name].ratio_p90 - 1) < 0.2
    base = {x.report_name: x for x in sketches.baseline_of_days(days).collect()}
    for name in ("r0", "r1", "r2"):
        own = np.array([x[3] for x in rows if x[1] == name])
        away = np.abs(own - base[name].median)
        assert abs((away <= base[name].mad).mean() - 0.5) < 0.04  # the rank of the MAD, of two ranks of a sketch
    few = {x.run_id for x in sketches.anomalies_of_days(df, days).collect()}
    all_ = {x.run_id for x in anomalies.anomalies_global(df).collect()}
    assert len(few & all_) > 0.8 * len(few | all_) > 0
    assert sketches.features_of_days(sketches.daily_sketches(df.limit(0))).count() == 0


def test_queries_of_days(spark):
    for name in ("report_features_of_days", "quantile_drift_of_days", "anomalies_of_days"):
        assert catalog.QUERIES[name](spark, SF).count() >= 0
