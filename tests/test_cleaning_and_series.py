"""Guards, ties and nulls on frames worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from joblore.functions.columns import mase_band, robust_z, severity
from joblore.operators import clean, joins, rollups, series
from joblore.sources import runs

RUN = "run_id long, report_name string, report_type string, execution_status string, duration_seconds long, creation_date timestamp, started_at timestamp, parameters string"


def at(text):
    return dt.datetime.fromisoformat(text)


def frame(spark, rows):
    """rows: (run_id, name, status, seconds, started_at[, created])"""
    out = [(r[0], r[1], "BI", r[2], r[3], r[5] if len(r) > 5 else r[4], r[4], None) for r in rows]
    return clean.add_time_features(spark.createDataFrame(out, RUN))


def test_status_and_duration(spark):
    rows = [("1", "yes", None), ("0", "T", None), (None, None, "boom"), ("n", "0", None)]
    df = spark.createDataFrame(rows, "cancelled string, failed string, error_message string")
    assert [r.execution_status for r in clean.derive_status(df).collect()] == ["cancelled", "failed", "failed", "success"]
    df = spark.createDataFrame([(at("2024-01-01T00:00:00.900"), at("2024-01-01T00:00:01.100")), (at("2024-01-01"), None)], "started_at timestamp, completed_at timestamp")
    assert [(r.duration_seconds, r.duration_ms) for r in clean.derive_duration(df).collect()] == [(1, 200), (None, None)]


def test_sanitize_and_dates(spark):
    df = frame(spark, [(1, "a", "success", 0, at("2024-01-01")), (2, "a", "success", 1, at("2024-01-01T23:59:59")), (3, "a", "success", 21600, at("2024-01-02")), (4, "a", "success", None, at("2024-01-02")), (5, "a", "success", 5, None)])
    assert [r.run_id for r in clean.quality_sanitize(df).collect()] == [2]
    ids = lambda x: sorted(r.run_id for r in x.collect())
    assert ids(clean.filter_date_range(df, "2024-01-01", "2024-01-01")) == [1, 2]
    assert ids(clean.filter_date_range(df, "2024-01-01", "2024-01-02", end_exclusive_time=True)) == [1, 2, 3, 4]
    assert ids(clean.apply_filters(df, ["2024-01-02"], [], [], [])) == [1, 2, 3, 4, 5]  # one date restricts nothing
    assert clean.filter_options(df.limit(0)).filter("kind != 'date'").count() == 0


def test_weekday_flags(spark):
    df = clean.add_calendar_flags(frame(spark, [(i, "a", "success", 1, at(f"2024-03-{d}")) for i, d in enumerate(("29", "30", "31"))]))
    assert [(r.weekday, r.is_business_day, r.is_end_of_month) for r in df.orderBy("run_id").collect()] == [(4, True, False), (5, False, False), (6, False, True)]


def test_dedupe(spark):
    df = frame(spark, [(1, "a", "success", 1, at("2024-01-02")), (1, "a", "success", 2, at("2024-01-01")), (2, "b", "success", 3, None)])
    assert sorted((r.run_id, r.duration_seconds) for r in clean.dedupe_runs(df).collect()) == [(1, 2), (2, 3)]


def test_backlogs_agree(spark):
    h = at("2024-01-01T10:00:00")
    hour = dt.timedelta(hours=1)
    rows = [(1, "a", "success", 1, h, h), (2, "a", "success", 1, h + hour, h), (3, "a", "success", 1, h + 3 * hour, h - hour / 2), (4, "a", "success", 1, h + hour / 2, h + hour / 3)]
    df, grid = frame(spark, rows), spark.createDataFrame([(h + i * hour,) for i in range(5)], "timestamp_hour timestamp")
    counts = [[r.backlog for r in f(df, grid).orderBy("timestamp_hour").collect()] for f in (joins.backlog_interval_count, joins.backlog_running)]
    assert counts == [[2, 1, 1, 0, 0]] * 2  # created on the hour waits; started on the hour doesn't


def test_asof_takes_the_last_of_ties(spark):
    left = spark.createDataFrame([("x", 5, 1), ("x", 0, 2), ("y", 9, 3)], "k string, t long, id long")
    right = spark.createDataFrame([("x", 1, "a"), ("x", 5, "b"), ("x", 5, "c"), ("x", 6, "d")], "k string, t long, v string")
    got = joins.asof_backward(left, right, "t", ["v"], ["k"], tie="v").collect()
    assert sorted((r.id, r.v) for r in got) == [(1, "c"), (2, None), (3, None)]


def test_changes_before(spark):
    runs_ = spark.createDataFrame([(1, at("2024-01-05"), "reports\\a"), (2, at("2024-01-01"), "reports/a"), (3, at("2024-01-05"), None)], "run_id long, started_at timestamp, action_path string")
    commits = spark.createDataFrame([("a.sql", at(f"2024-01-0{d}"), str(d), "x", "m") for d in range(2, 9)] + [("a", at("2024-02-01"), "z", "x", "m")], "path string, commit_ts timestamp, hash string, author string, message string")
    got = joins.changes_before(runs_, commits, 3).collect()
    assert sorted((r.run_id, r["rank"], r.hash) for r in got) == [(1, 1, "5"), (1, 2, "4"), (1, 3, "3")]


def test_hours_are_filled_per_key(spark):
    h = at("2024-01-01T10:00:00")
    rows = spark.createDataFrame([("a", h, 2), ("a", h + dt.timedelta(hours=3), 1), ("b", h, 5)], "k string, timestamp_hour timestamp, report_count long")
    got = series.fill_hours(rows, ["k"]).orderBy("k", "timestamp_hour").collect()
    assert [(r.k, r.report_count) for r in got] == [("a", 2), ("a", 0), ("a", 0), ("a", 1), ("b", 5)]
    assert series.fill_hours(rows.limit(0), ["k"]).columns == ["k", "timestamp_hour", "report_count"] and series.fill_hours(rows.limit(0), ["k"]).count() == 0


def test_lags_and_rolls(spark):
    h = at("2024-01-01")
    rows = spark.createDataFrame([(h + dt.timedelta(hours=i), i + 1) for i in range(6)], "timestamp_hour timestamp, report_count long")
    zero = series.rolling_features(series.lag_features(rows)).orderBy("timestamp_hour").collect()
    assert [r.y_lag_2 for r in zero] == [0, 0, 1, 2, 3, 4]
    assert [r.y_rolling_mean_3 for r in zero] == [0, 0, 1, 2, 3, 4]  # (0 + 1 + 2) / 3 is the first whole window
    drop = series.rolling_features(series.lag_features(rows, head="drop"), head="drop").orderBy("timestamp_hour").collect()
    assert [r.y_rolling_mean_3 for r in drop] == [None, None, None, 2, 3, 4]


def test_parameter_spans(spark):
    texts = ["startDate=2024-01-01&endDate=2024-01-11", '{"fechaInicio": "2024-01-01", "fechaFin": "2024-01-03"}', "<StartDate>2024-01-05</StartDate><EndDate>2024-01-01</EndDate>", "from 01/02/2024 to 2024-02-11", "2024-99-99", None]
    for text, keyed, anywhere in zip(texts, (10, 2, None, None, None, None), (10, 2, 4, 10, 0, 0), strict=True):
        df = frame(spark, [(1, "a", "success", 1, at("2024-01-01"))]).withColumn("parameters", F.lit(text))
        got = [r.avg_param_span_days for r in series.param_span_keyed(df).collect()]
        assert got == ([] if keyed is None else [keyed]), text
        assert series.param_span_any(df).first().avg_param_span_days == anywhere, text


def test_column_functions(spark):
    row = spark.range(1).select(robust_z(F.lit(60.0), F.lit(30.0), F.lit(5.0)).alias("z"), severity(F.lit(7.0)).alias("a"), severity(F.lit(2.9)).alias("b"), mase_band(F.lit(1.1)).alias("c")).first()
    assert row.z == pytest.approx(4.047, abs=1e-3) and (row.a, row.b, row.c) == ("severe", None, "similar")


def test_rollup_guards(spark):
    df = frame(spark, [(i, f"r{i % 3}", "failed" if i % 4 == 0 else "success", 10 + i, at("2024-01-01T05:00:00")) for i in range(20)])
    assert rollups.failure_analysis(df, 10).count() == 0 and rollups.failure_analysis(df, 6).count() == 3
    assert rollups.weekday_hour_heatmap(df).count() == 7
    text = {r.execution_status: r.breakdown for r in rollups.trend_breakdown(df, 2).collect()}
    assert text["failed"] == "r0: 2, r1: 2, 1 more"
    empty = rollups.kpis(df.limit(0)).first()
    assert empty.total_runs == 0 and empty.mean_success_seconds is None


def test_files(spark, tmp_path):
    (tmp_path / "runs.csv").write_text("run_id,report_name,report_type,creation_date,started_at,completed_at,parameters\n1,a,BI,2024-01-01 00:00:00,2024-01-01 00:00:01.500,bad,x\n2,b,BI,,2024-01-01 00:00:01.123456,2024-01-01 00:00:02,\n")
    got = runs.read_runs_csv(spark, str(tmp_path / "runs.csv")).orderBy("run_id").collect()
    assert got[0].completed_at is None and got[0].started_at.microsecond == 500000 and got[1].started_at.microsecond == 123456
    with pytest.raises(ValueError, match="lacks"):
        runs.read_hourly_csv(spark, str(tmp_path / "runs.csv"))
    table = spark.createDataFrame([(h, 1.0 + h / 10) for h in range(24)], "hour int, value double")
    runs.write_hour_map(table, str(tmp_path / "map"))
    assert runs.read_hour_map(spark, str(tmp_path / "map")).count() == 24
    assert runs.read_hour_map(spark, str(tmp_path / "map"), correction=True).count() == 0  # an old multiplicative map
    runs.write_hour_map(table.withColumn("value", F.col("value") - 2), str(tmp_path / "map"))
    assert runs.read_hour_map(spark, str(tmp_path / "map"), correction=True).count() == 24
