"""All registered queries, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblore.functions import columns as fn
from joblore.operators import anomalies, backtest, clean, drift, evaluate, forecast, joins, queues, rollups, series, sketches
from joblore.plans.sql import CTE, comparable, query
from joblore.sources import adapter, runs
from joblore.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Doubles to six places, times and dates as text: values that two engines agree on."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6) + 0.0
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, job: Callable[[SparkSession, str], DataFrame], tables: str | None = None, body: str = "", floats: str = "", times: str = "", dates: str = "", ints: str = "", **ctes: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(job(spark, sf_dir))
    if tables is not None:
        ORACLE_SQL[name] = comparable(query(tables, body, **ctes), floats, times, dates, ints)


ex, san, hol = adapter.executions, adapter.sanitised, lambda s: adapter.holidays(s)


def ok(s, d):
    return san(s, d).filter(fn.success())


def valid(s, d):
    return clean.valid_executions(san(s, d))


def hourly(s, d):
    """The gap-free series of all runs."""
    return series.fill_hours(series.hourly_counts(san(s, d)))


def keyed(s, d):
    return series.fill_hours(series.hourly_counts(san(s, d), ["report_type"]), ["report_type"])


def split(s, d):
    return series.temporal_split(series.naive_predictions(hourly(s, d)))


def part(s, d, name):
    df = split(s, d).filter(F.col("split") == name)
    return df.withColumns({"y": F.col("report_count"), "y_pred": F.col("pred_last_hour").cast("double"), "hour": F.hour("timestamp_hour")})


def raw_forecast(s, d):
    """The naive forecast of the test hours with bands, as input of the corrections."""
    return raw_of(part(s, d, "test"))


def raw_of(test):
    df = test.withColumn("rn", F.row_number().over(series.W.orderBy("timestamp_hour")) - 1)
    p = F.col("pred_last_hour")
    return df.select(
        F.col("timestamp_hour").alias("ds"), F.col("rn").alias("step"), "hour", F.weekday("timestamp_hour").alias("weekday"), F.col("report_count").alias("y_actual"), (p * 0.7131).alias("y_p10"),
        p.cast("double").alias("y_p50"), p.cast("double").alias("y_pred"), (p * 1.3873).alias("y_p90"), F.when(F.col("pred_last_week") > p, 0.6).otherwise(0.3).alias("p_spike"),
    )


def hits(s, d):
    return evaluate.hit_labels(series.naive_predictions(hourly(s, d)), "report_count", ["pred_last_hour", "pred_last_week"])


def doubles(s, d):
    return anomalies.double_runs(san(s, d))


RUN = "run_id, report_name, duration_seconds, execution_status"
RUN_LIST = RUN.split(", ")
EX = "run_id, user_id, creation_date, started_at, completed_at, duration_seconds, execution_status, report_id, report_name, report_type, report_size, queue_id, action_path, parameters, deprecated, deleted"

# --- A: sources and sinks
register("read_executions", lambda s, d: ex(s, d), "ex", f"SELECT {EX} FROM ex", times="creation_date started_at completed_at")
register("read_executions_window", lambda s, d: runs.read_executions(adapter.runs(s, d), adapter.reports(s, d), adapter.queues(s, d), "2024-01-05", "2024-01-10").select("run_id", "started_at"),
         "ex", "SELECT run_id, started_at FROM ex WHERE CAST(started_at AS DATE) BETWEEN '2024-01-05' AND '2024-01-10'", times="started_at")

# --- B: cleaning and filters
register("derive_status", lambda s, d: clean.derive_status(adapter.runs(s, d)).select("run_id", "execution_status"), "ex", "SELECT run_id, execution_status FROM ex")
register("derive_duration", lambda s, d: clean.derive_duration(adapter.runs(s, d)).select("run_id", "duration_seconds", "duration_ms"), "runs",
         "SELECT run_id, date_diff('second', started_at, completed_at) AS duration_seconds, epoch_ms(completed_at) - epoch_ms(started_at) AS duration_ms FROM runs")
register("dedupe_runs", lambda s, d: clean.dedupe_runs(ex(s, d).unionByName(ex(s, d).filter("run_id % 3 = 0"))).select("run_id", "started_at"), "ex", "SELECT run_id, started_at FROM ex", times="started_at")
register("fill_missing_duration", lambda s, d: clean.fill_missing_duration(ex(s, d).withColumn("duration_seconds", F.expr("CASE WHEN run_id % 5 <> 0 THEN duration_seconds END"))).select("run_id", "duration_seconds"), "ex",
         "SELECT run_id, coalesce(CASE WHEN run_id % 5 <> 0 THEN duration_seconds END, (epoch_ms(completed_at) - epoch_ms(started_at)) // 1000) AS duration_seconds FROM ex")
register("normalize_flags", lambda s, d: clean.normalize_flags(ex(s, d)).select("run_id", "deprecated", "deleted"), "ex", "SELECT run_id, deprecated = 'Yes' AS deprecated, deleted = 'TRUE' AS deleted FROM ex")
register("add_time_features", lambda s, d: clean.add_time_features(ex(s, d)).select("run_id", "date", "hour", "weekday"), "tf", "SELECT run_id, date, hour, weekday FROM tf", dates="date")
register("add_calendar_flags", lambda s, d: clean.add_calendar_flags(ex(s, d)).select("run_id", "time_hour", "month_year", "is_business_day", "is_end_of_month"), "tf",
         "SELECT run_id, date_trunc('hour', started_at) AS time_hour, date_trunc('month', date) AS month_year, weekday < 5 AS is_business_day, last_day(date) = date AS is_end_of_month FROM tf", times="time_hour", dates="month_year")
register("quality_sanitize", lambda s, d: san(s, d).select("run_id", "duration_seconds"), "san", "SELECT run_id, duration_seconds FROM san")
register("filter_date_range", lambda s, d: clean.filter_date_range(ex(s, d), "2024-01-08", "2024-01-12").select("run_id"), "tf", "SELECT run_id FROM tf WHERE date BETWEEN '2024-01-08' AND '2024-01-12'")
register("apply_filters", lambda s, d: clean.apply_filters(san(s, d), ["2024-01-08", "2024-01-20"], ["AFRICA", "ASIA"], ["success", "failed"], []).select("run_id"), "san",
         "SELECT run_id FROM san WHERE date BETWEEN '2024-01-08' AND '2024-01-20' AND report_type IN ('AFRICA', 'ASIA') AND execution_status IN ('success', 'failed')")
register("filter_options", lambda s, d: clean.filter_options(san(s, d)), "san", """
    SELECT 'date' AS kind, 0 AS position, CAST(min(date) AS VARCHAR) AS value FROM san UNION ALL SELECT 'date', 1, CAST(max(date) AS VARCHAR) FROM san
    UNION ALL SELECT 'type', row_number() OVER (ORDER BY report_type) - 1, report_type FROM (SELECT DISTINCT report_type FROM san)
    UNION ALL SELECT 'name', row_number() OVER (ORDER BY n DESC, report_name) - 1, report_name FROM (SELECT report_name, count(*) AS n FROM san GROUP BY 1 ORDER BY n DESC, report_name LIMIT 200)""")  # fmt: skip
register("anonymize_reports", lambda s, d: clean.anonymize_reports(ex(s, d)).select("run_id", "report_name"), "ex", "SELECT run_id, 'report_' || report_id AS report_name FROM ex")
register("valid_executions", lambda s, d: valid(s, d).select(RUN_LIST), "valid", f"SELECT {RUN} FROM valid")
register("drop_negative", lambda s, d: clean.drop_negative(ex(s, d)).select("run_id"), "ex", "SELECT run_id FROM ex WHERE duration_seconds >= 0")

# --- J: joins
register("join_dimensions", lambda s, d: joins.join_dimensions(adapter.runs(s, d), adapter.reports(s, d), adapter.queues(s, d)).select("run_id", "report_name", "report_type", "report_size"), "ex", "SELECT run_id, report_name, report_type, report_size FROM ex")
register("attach_backlog_to_runs", lambda s, d: joins.attach_backlog_to_runs(san(s, d), joins.backlog_running(san(s, d), hourly(s, d))).select("run_id", "backlog"), "back",
         "SELECT run_id, coalesce(backlog, 0) AS backlog FROM san LEFT JOIN back ON date_trunc('hour', started_at) = timestamp_hour", ints="backlog")
register("asof_backward", lambda s, d: joins.asof_backward(san(s, d).select("run_id", "report_type", F.col("started_at").alias("ts")), keyed(s, d).select("report_type", F.col("timestamp_hour").alias("ts"), "report_count"), "ts", ["report_count"], ["report_type"]).select("run_id", "report_count"), "kh",
         "SELECT run_id, report_count FROM san ASOF LEFT JOIN kh ON san.report_type = kh.report_type AND san.started_at >= kh.timestamp_hour")
register("backlog_interval_count", lambda s, d: joins.backlog_interval_count(san(s, d), hourly(s, d)), "back", "SELECT * FROM back", times="timestamp_hour", ints="backlog")
register("backlog_running", lambda s, d: joins.backlog_running(san(s, d), hourly(s, d)), "back", "SELECT * FROM back", times="timestamp_hour", ints="backlog")
register("restrict_to_top", lambda s, d: joins.restrict_to_top(san(s, d), "report_name", 10).select("run_id"), "san",
         "SELECT run_id FROM san WHERE report_name IN (SELECT report_name FROM (SELECT report_name, count(*) AS n FROM san GROUP BY 1 ORDER BY n DESC, report_name LIMIT 10))")
register("join_forecast_actuals", lambda s, d: joins.join_forecast_actuals(raw_forecast(s, d).drop("y_actual"), hourly(s, d).select(F.col("timestamp_hour").alias("ds"), F.col("report_count").alias("y_actual"))).select("ds", "y_actual", "y_pred"), "fc",
         "SELECT ds, y_actual, y_pred FROM fc WHERE y_pred IS NOT NULL", "y_pred", "ds")
register("yoy_align", lambda s, d: joins.yoy_align(hourly(s, d).groupBy(F.to_date("timestamp_hour").alias("date")).agg(F.sum("report_count").alias("y")), s.sql("SELECT explode(sequence(DATE'2024-12-25', DATE'2025-01-20')) AS date")), "h",
         "SELECT r.date, y AS y_last_year FROM (SELECT CAST(unnest(generate_series(DATE '2024-12-25', DATE '2025-01-20', INTERVAL 1 DAY)) AS DATE) AS date) r LEFT JOIN daily ON daily.date + 364 = r.date", dates="date", ints="y_last_year",
         daily="SELECT CAST(timestamp_hour AS DATE) AS date, sum(report_count) AS y FROM h GROUP BY 1")
register("holiday_flag", lambda s, d: joins.holiday_flag(san(s, d), hol(s)).groupBy("date", "is_holiday").agg(F.count("*").alias("runs")), "san hol", "SELECT date, CAST(date IN (SELECT date FROM hol) AS INTEGER) AS is_holiday, count(*) AS runs FROM san GROUP BY ALL", dates="date")
register("changes_before", lambda s, d: joins.changes_before(anomalies.anomalies_global(san(s, d)), adapter.commits(s, d)), "ok", """
    SELECT run_id, rank, path, commit_ts, hash, author, message FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY commit_ts DESC, hash) AS rank FROM (
            SELECT run_id, pos, t.path, commit_ts, hash, author, message, min(pos) OVER (PARTITION BY run_id) AS best
            FROM tried t JOIN commits c ON t.path = c.path AND commit_ts <= started_at) WHERE pos = best) WHERE rank <= 5""", times="commit_ts",
         commits="""SELECT 'reports/' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '.sql' ELSE '' END AS path, TIMESTAMP '2024-01-01' + to_seconds((p_partkey * 7919) % 2592000) AS commit_ts,
                    md5(CAST(p_partkey AS VARCHAR)) AS hash, 'dev' || p_partkey % 7 AS author, p_name AS message FROM part""",
         med="SELECT report_name, quantile_cont(duration_seconds, 0.5) AS median FROM san GROUP BY 1",
         mad="SELECT report_name, any_value(median) AS median, quantile_cont(abs(duration_seconds - median), 0.5) AS mad FROM san JOIN med USING (report_name) GROUP BY 1",
         anomaly="SELECT ok.* FROM ok JOIN mad USING (report_name) WHERE mad > 0 AND 0.6745 * (duration_seconds - median) / (mad + 1e-9) > 5",
         tried="""SELECT run_id, started_at, unnest([0, 1, 2, 3]) AS pos, unnest([action_path, action_path || '.sql', split_part(action_path, '/', 2), split_part(action_path, '/', 2) || '.sql']) AS path FROM anomaly""")

# --- G: rollups
register("kpis", lambda s, d: rollups.kpis(san(s, d)), "san", """
    SELECT count(*) AS total_runs, avg(duration_seconds) FILTER (execution_status = 'success') AS mean_success_seconds, count_if(execution_status = 'failed') * 100.0 / count(*) AS failure_rate_pct FROM san""", "mean_success_seconds failure_rate_pct")  # fmt: skip
register("median_of_mads", lambda s, d: rollups.median_of_mads(san(s, d)), "ok", "SELECT quantile_cont(mad, 0.5) AS median_of_mads FROM (SELECT report_name, quantile_cont(abs(duration_seconds - m), 0.5) AS mad FROM ok JOIN med USING (report_name) GROUP BY 1)", "median_of_mads",
         med="SELECT report_name, quantile_cont(duration_seconds, 0.5) AS m FROM ok GROUP BY 1")
register("null_profile", lambda s, d: rollups.null_profile(ex(s, d).select("run_id", "completed_at", "duration_seconds", "parameters")), "ex",
         " UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS nulls FROM ex" for c in ("run_id", "completed_at", "duration_seconds", "parameters")), ints="nulls")
register("data_window", lambda s, d: rollups.data_window(san(s, d)), "san", "SELECT min(started_at) AS first_start, max(started_at) AS last_start FROM san", times="first_start last_start")
register("trend_by_status", lambda s, d: rollups.trend_by_status(san(s, d)), "san", """
    SELECT date, execution_status, count(run_id) AS runs FROM (SELECT DISTINCT date FROM san) CROSS JOIN (SELECT DISTINCT execution_status FROM san) LEFT JOIN san USING (date, execution_status) GROUP BY ALL""", dates="date")  # fmt: skip
register("trend_breakdown", lambda s, d: rollups.trend_breakdown(san(s, d), 3), "san", """
    SELECT date, execution_status, sum(n) AS runs, string_agg(report_name || ': ' || n, ', ' ORDER BY rn) FILTER (rn <= 3) || CASE WHEN count_if(rn > 3) > 0 THEN ', ' || count_if(rn > 3) || ' more' ELSE '' END AS breakdown
    FROM (SELECT *, row_number() OVER (PARTITION BY date, execution_status ORDER BY n DESC, report_name) AS rn FROM (SELECT date, execution_status, report_name, count(*) AS n FROM san GROUP BY ALL)) GROUP BY date, execution_status""", dates="date", ints="runs")  # fmt: skip
register("slowest_reports", lambda s, d: rollups.slowest_reports(san(s, d)), "ok", "SELECT report_name, avg(duration_seconds) AS mean_seconds FROM ok GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "mean_seconds")
register("top_failures", lambda s, d: rollups.top_failures(san(s, d)), "san", "SELECT report_name, count(*) AS failures FROM san WHERE execution_status = 'failed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
register("duration_histogram", lambda s, d: rollups.duration_histogram(san(s, d)), "ok", "SELECT duration_seconds // 30 * 30 AS bin_start, count(*) AS runs FROM ok GROUP BY 1")
register("hourly_load", lambda s, d: rollups.hourly_load(san(s, d)), "san", "SELECT hour, count(*) AS runs FROM san GROUP BY 1")
register("weekday_hour_heatmap", lambda s, d: rollups.weekday_hour_heatmap(san(s, d)), "san", "SELECT weekday, " + ", ".join(f"count_if(hour = {h}) AS h{h}" for h in range(24)) + " FROM (SELECT unnest(range(7)) AS weekday) LEFT JOIN san USING (weekday) GROUP BY 1", ints=" ".join(f"h{h}" for h in range(24)))
register("day_hour_load", lambda s, d: rollups.day_hour_load(san(s, d)), "san", "SELECT weekday, hour, count(*) AS runs FROM san GROUP BY ALL")
register("monthly_error", lambda s, d: rollups.monthly_error(san(s, d)), "ok", "SELECT date_trunc('month', date) AS month_year, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM (SELECT date, duration_seconds - avg(duration_seconds) OVER (PARTITION BY report_name) AS e FROM ok) GROUP BY 1", "mae rmse", dates="month_year")
register("monthly_duration", lambda s, d: rollups.monthly_duration(san(s, d)), "ok", "SELECT date_trunc('month', date) AS month_year, report_name, avg(duration_seconds) AS mean_seconds FROM ok GROUP BY ALL", "mean_seconds", dates="month_year")
register("critical_reports", lambda s, d: rollups.critical_reports(san(s, d)), "ok", "SELECT report_name, count(*) AS runs, avg(duration_seconds) AS mean_seconds, sum(duration_seconds) AS total_seconds, stddev_samp(duration_seconds) AS std_seconds FROM ok GROUP BY 1", "mean_seconds std_seconds", ints="total_seconds")
register("success_rate_by_type", lambda s, d: rollups.success_rate_by_type(san(s, d)), "san", "SELECT report_type, count(*) AS total, count_if(execution_status = 'success') AS ok, ok * 100.0 / total AS success_rate FROM san GROUP BY 1", "success_rate", ints="ok")
register("impact_profile", lambda s, d: rollups.impact_profile(valid(s, d)), "valid", """
    SELECT report_name, count(*) AS runs, count(DISTINCT user_id) AS users, avg(duration_seconds) AS mean_seconds, quantile_cont(duration_seconds, 0.5) AS median_seconds, quantile_cont(duration_seconds, 0.95) AS p95_seconds,
           sum(duration_seconds) AS impact_score, avg(CAST(weekday < 5 AS INTEGER)) AS pct_business_day, avg(CAST(last_day(date) = date AS INTEGER)) AS pct_end_of_month, min(report_type) AS report_type, min(report_size) AS report_size,
           p95_seconds / median_seconds AS variability_ratio FROM valid GROUP BY 1""", "mean_seconds median_seconds p95_seconds pct_business_day pct_end_of_month variability_ratio", ints="impact_score")  # fmt: skip
register("failure_analysis", lambda s, d: rollups.failure_analysis(san(s, d)), "san", """
    SELECT report_name, count(*) AS attempts, count_if(execution_status = 'failed') AS failures, count_if(execution_status = 'cancelled') AS cancellations, (failures + cancellations) * 100.0 / attempts AS failure_rate_pct
    FROM san GROUP BY 1 HAVING count(*) >= 10""", "failure_rate_pct", ints="failures cancellations")  # fmt: skip
register("hourly_compute", lambda s, d: rollups.hourly_compute(valid(s, d)), "valid", "SELECT hour, count(*) AS runs, sum(duration_seconds) AS compute_seconds FROM valid GROUP BY 1", ints="compute_seconds")
register("report_features", lambda s, d: rollups.report_features(san(s, d)), "feat", "SELECT * FROM feat", "mean_seconds median_seconds p95_seconds failure_rate cancel_rate", ints="successes failures cancellations")
register("report_history", lambda s, d: rollups.report_history(san(s, d), "red widget"), "san", """
    SELECT run_id, started_at, duration_seconds, execution_status, count(*) OVER () AS total_runs, avg(duration_seconds) OVER () AS mean_seconds, count(CASE WHEN execution_status = 'failed' THEN 1 END) OVER () AS failures FROM san WHERE report_name = 'red widget'""", "mean_seconds", "started_at")  # fmt: skip
register("report_daily", lambda s, d: rollups.report_daily(san(s, d)), "san", "SELECT report_name, date, avg(duration_seconds) AS mean_seconds, count(*) AS runs FROM san GROUP BY ALL", "mean_seconds", dates="date")
register("series_summary", lambda s, d: rollups.series_summary(hourly(s, d)), "h", "SELECT count(*) AS hours, sum(report_count) AS total, avg(report_count) AS mean, max(report_count) AS max FROM h", "mean", ints="total")
register("series_describe", lambda s, d: rollups.series_describe(hourly(s, d)), "h", """
    SELECT count(report_count) AS count, avg(report_count) AS mean, stddev_samp(report_count) AS std, min(report_count) AS min, quantile_cont(report_count, 0.25) AS p25, quantile_cont(report_count, 0.5) AS p50,
           quantile_cont(report_count, 0.75) AS p75, max(report_count) AS max FROM h""", "mean std p25 p50 p75")  # fmt: skip
register("main_type_per_hour", lambda s, d: rollups.main_type_per_hour(san(s, d)), "kcnt", "SELECT timestamp_hour, report_type AS main_type FROM kcnt QUALIFY row_number() OVER (PARTITION BY timestamp_hour ORDER BY report_count DESC, report_type) = 1", times="timestamp_hour")

# --- T: series and features
H, TS = "timestamp_hour", "timestamp_hour"
register("hourly_counts", lambda s, d: series.hourly_counts(san(s, d), ["report_type"]), "kcnt", "SELECT * FROM kcnt", times=TS)
register("fill_hours", lambda s, d: keyed(s, d), "kh", "SELECT * FROM kh", times=TS)
register("calendar_features", lambda s, d: series.calendar_features(hourly(s, d), hol(s)), "cal", "SELECT *, is_weekend * is_peak_hour AS weekend_x_peak, is_holiday * is_peak_hour AS holiday_x_peak, greatest(is_weekend, is_holiday) * is_peak_hour AS weekend_or_holiday_x_peak FROM cal", times=TS)
register("cyclic_features", lambda s, d: series.cyclic_features(hourly(s, d)), "cal", "SELECT timestamp_hour, report_count, " + ", ".join(f"{f}({c} * 2 * pi() / {p}) AS {c}_{f}" for c, p in (("hour", 24), ("weekday", 7), ("month", 12)) for f in ("sin", "cos")) + " FROM cal",
         " ".join(f"{c}_{f}" for c in ("hour", "weekday", "month") for f in ("sin", "cos")), TS)
_FOURIER = [(f"fourier_{n}_{f}_{i}", f, i, p) for n, p in (("daily", 24), ("weekly", 168)) for i in (1, 2, 3) for f in ("sin", "cos")]
register("fourier_features", lambda s, d: series.fourier_features(keyed(s, d), ["report_type"]), "kh", "SELECT report_type, timestamp_hour, report_count, " + ", ".join(f"{f}(t * {i} * 2 * pi() / {p}) AS {n}" for n, f, i, p in _FOURIER) + " FROM (SELECT *, date_diff('hour', min(timestamp_hour) OVER (PARTITION BY report_type), timestamp_hour) AS t FROM kh)",
         " ".join(x[0] for x in _FOURIER), TS)
register("lag_features", lambda s, d: series.lag_features(hourly(s, d)), "lagged", "SELECT * FROM lagged", times=TS)
_ROLLS = "y_rolling_mean_3 y_rolling_mean_24 y_rolling_mean_168 y_rolling_std_3 y_rolling_std_24"
register("rolling_features", lambda s, d: series.rolling_features(hourly(s, d)), "rolled", f"SELECT timestamp_hour, report_count, {', '.join(_ROLLS.split())} FROM rolled", _ROLLS, TS)
_LOGS = " ".join(f"log_{c}" for c in series.LOGGED)
register("log_features", lambda s, d: series.log_features(series.rolling_features(series.lag_features(hourly(s, d)))).select(TS, *_LOGS.split()), "rolled", "SELECT timestamp_hour, " + ", ".join(f"ln(1 + greatest({c}, 0)) AS log_{c}" for c in series.LOGGED) + " FROM rolled", _LOGS, TS)
register("param_span_keyed", lambda s, d: series.param_span_keyed(san(s, d)), "keyed", "SELECT * FROM keyed", "avg_param_span_days", TS)
register("param_span_any", lambda s, d: series.param_span_any(san(s, d)), "san", r"""
    SELECT date_trunc('hour', started_at) AS timestamp_hour, avg(CASE WHEN len(days) >= 2 THEN date_diff('day', list_min(days), list_max(days)) ELSE 0 END) AS avg_param_span_days FROM (
        SELECT started_at, [coalesce(TRY_CAST(x AS DATE), CAST(try_strptime(x, '%d/%m/%Y') AS DATE)) FOR x IN regexp_extract_all(coalesce(parameters, ''), '\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}')] AS days FROM san) GROUP BY 1""", "avg_param_span_days", TS)  # fmt: skip
register("factorize_type", lambda s, d: series.factorize_type(rollups.main_type_per_hour(san(s, d))), "kcnt", """
    SELECT label, row_number() OVER (ORDER BY first, label) - 1 AS id FROM (SELECT report_type AS label, min(timestamp_hour) AS first FROM (
        SELECT * FROM kcnt QUALIFY row_number() OVER (PARTITION BY timestamp_hour ORDER BY report_count DESC, report_type) = 1) GROUP BY 1)""", ints="id")  # fmt: skip
_ENRICHED = "timestamp_hour report_count hour weekday is_weekend is_peak_hour is_holiday is_month_end y_lag_1 y_lag_168 y_rolling_mean_24 y_rolling_std_24 log_y_lag_1 backlog avg_param_span_days tipo_reporte_id".split()
register("enrich_hourly", lambda s, d: _features(s, d).select(_ENRICHED), "cal rolled back keyed", """
    SELECT c.timestamp_hour, c.report_count, hour, weekday, is_weekend, is_peak_hour, is_holiday, is_month_end, y_lag_1, y_lag_168, y_rolling_mean_24, y_rolling_std_24, ln(1 + y_lag_1) AS log_y_lag_1, backlog,
           coalesce(k.avg_param_span_days, 0) AS avg_param_span_days, 0 AS tipo_reporte_id
    FROM cal c JOIN rolled r USING (timestamp_hour) JOIN back b USING (timestamp_hour) ASOF LEFT JOIN keyed k ON c.timestamp_hour >= k.timestamp_hour""", "y_rolling_mean_24 y_rolling_std_24 log_y_lag_1 avg_param_span_days", TS, ints="backlog")  # fmt: skip
register("prepare_training", lambda s, d: series.prepare_training(san(s, d), hol(s)).select(TS, "report_count", "y_lag_1", "y_lag_168", "y_rolling_mean_24", "main_type"), "cnt kcnt", """
    SELECT timestamp_hour, report_count, y_lag_1, y_lag_168, m AS y_rolling_mean_24, report_type AS main_type FROM (
        SELECT *, lag(report_count, 1) OVER w AS y_lag_1, lag(report_count, 168) OVER w AS y_lag_168, avg(report_count) OVER (ORDER BY timestamp_hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m,
               row_number() OVER w AS i FROM cnt WINDOW w AS (ORDER BY timestamp_hour))
    JOIN (SELECT timestamp_hour, report_type FROM kcnt QUALIFY row_number() OVER (PARTITION BY timestamp_hour ORDER BY report_count DESC, report_type) = 1) USING (timestamp_hour) WHERE i > 168""", "y_rolling_mean_24", TS)  # fmt: skip
_KEYED_ROLLS = {
    "kl": "SELECT *, lag(report_count, 1, 0) OVER w AS y_lag_1, lag(report_count, 168, 0) OVER w AS y_lag_168 FROM kh WINDOW w AS (PARTITION BY report_type ORDER BY timestamp_hour)",
    "kr": """SELECT *, coalesce(CASE WHEN count(*) OVER p = 24 THEN avg(y_lag_1) OVER p END, 0) AS y_rolling_mean_24, coalesce(CASE WHEN count(*) OVER p = 24 THEN stddev_samp(y_lag_1) OVER p END, 0) AS y_rolling_std_24
             FROM kl WINDOW p AS (PARTITION BY report_type ORDER BY timestamp_hour ROWS 23 PRECEDING)""",
    "ks": CTE["keyed"].replace("SELECT date_trunc", "SELECT report_type, date_trunc", 1).replace("SELECT started_at", "SELECT report_type, started_at", 1).replace("GROUP BY 1", "GROUP BY ALL"),
}
_KEYED_COLUMNS = "report_type timestamp_hour report_count y_lag_1 y_lag_168 y_rolling_mean_24 y_rolling_std_24 backlog avg_param_span_days".split()
register("enrich_hourly_by_type", lambda s, d: series.enrich_hourly(stashed(s, "keyed", keyed(s, d)), san(s, d), hol(s), keys=["report_type"]).select(_KEYED_COLUMNS), "kh", """
    SELECT kr.report_type, kr.timestamp_hour, report_count, y_lag_1, y_lag_168, y_rolling_mean_24, y_rolling_std_24,
           (SELECT count(*) FROM san s WHERE s.report_type = kr.report_type AND creation_date <= kr.timestamp_hour) - (SELECT count(*) FROM san s WHERE s.report_type = kr.report_type AND started_at <= kr.timestamp_hour) AS backlog,
           coalesce(ks.avg_param_span_days, 0) AS avg_param_span_days FROM kr ASOF LEFT JOIN ks ON kr.report_type = ks.report_type AND kr.timestamp_hour >= ks.timestamp_hour""", "y_rolling_mean_24 y_rolling_std_24 avg_param_span_days", TS, ints="backlog", **_KEYED_ROLLS)  # fmt: skip
register("prepare_training_by_type", lambda s, d: series.prepare_training(san(s, d), hol(s), keys=["report_type"]).select("report_type", TS, "report_count", "y_lag_1", "y_lag_168", "y_rolling_mean_24"), "kcnt", """
    SELECT report_type, timestamp_hour, report_count, y_lag_1, y_lag_168, m AS y_rolling_mean_24 FROM (
        SELECT *, lag(report_count, 1) OVER w AS y_lag_1, lag(report_count, 168) OVER w AS y_lag_168, avg(report_count) OVER (PARTITION BY report_type ORDER BY timestamp_hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m,
               row_number() OVER w AS i FROM kcnt WINDOW w AS (PARTITION BY report_type ORDER BY timestamp_hour)) WHERE i > 168""", "y_rolling_mean_24", TS)  # fmt: skip
register("moving_average", lambda s, d: series.moving_average(hourly(s, d)), "h", """
    SELECT timestamp_hour, report_count, CASE WHEN count(*) OVER w = 24 THEN avg(report_count) OVER w END AS moving_average FROM h WHERE timestamp_hour >= (SELECT max(timestamp_hour) FROM h) - INTERVAL 7 DAY
    WINDOW w AS (ORDER BY timestamp_hour ROWS 23 PRECEDING)""", "moving_average", TS)  # fmt: skip
register("tail_window", lambda s, d: series.tail_window(keyed(s, d), ["report_type"], 48), "kh", "SELECT * FROM kh QUALIFY row_number() OVER (PARTITION BY report_type ORDER BY timestamp_hour DESC) <= 48", times=TS)
register("temporal_split", lambda s, d: series.temporal_split(keyed(s, d), ["report_type"]), "kh", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY report_type ORDER BY timestamp_hour) <= floor(count(*) OVER (PARTITION BY report_type) * 0.8) THEN 'train' ELSE 'test' END AS split FROM kh", times=TS)
register("naive_predictions", lambda s, d: series.naive_predictions(hourly(s, d)), "naive", "SELECT * FROM naive", times=TS)

# --- N: anomalies and double runs
_MAD = lambda keys, src="san": {
    "med": f"SELECT {keys}, quantile_cont(duration_seconds, 0.5) AS median FROM {src} GROUP BY ALL",
    "mad": f"SELECT {keys}, any_value(median) AS median, quantile_cont(abs(duration_seconds - median), 0.5) AS mad FROM {src} JOIN med USING ({keys}) GROUP BY {keys}",
}
_SCORE = "0.6745 * (duration_seconds - median) / (mad + 1e-9)"
_ROLL = lambda n: f"""SELECT *, quantile_cont(duration_seconds, [0.25, 0.5, 0.75]) OVER w AS q, count(*) OVER w AS c FROM san WINDOW w AS (PARTITION BY report_name ORDER BY started_at, run_id ROWS {n - 1} PRECEDING)"""
_PICK = lambda df: df.select("run_id", "score")
register("robust_z", lambda s, d: anomalies._baseline(san(s, d), ["report_name"]).select("run_id", fn.robust_z(F.col("duration_seconds"), F.col("median"), F.col("mad")).alias("score")).filter("score < 1e6"), "san", f"SELECT run_id, {_SCORE} AS score FROM san JOIN mad USING (report_name) WHERE {_SCORE} < 1e6", "score", **_MAD("report_name"))
register("anomalies_global", lambda s, d: _PICK(anomalies.anomalies_global(san(s, d))), "ok", f"SELECT run_id, {_SCORE} AS score FROM ok JOIN mad USING (report_name) WHERE mad > 0 AND {_SCORE} > 5", "score", **_MAD("report_name"))
register("anomalies_adaptive", lambda s, d: _PICK(anomalies.anomalies_adaptive(san(s, d))), "san", f"SELECT run_id, {_SCORE} AS score FROM (SELECT *, q[2] AS median, (q[3] - q[1]) / 1.349 AS mad FROM r WHERE c >= 5) WHERE mad > 0 AND execution_status = 'success' AND {_SCORE} > 5", "score", r=_ROLL(50))
register("anomalies_contextual", lambda s, d: _PICK(anomalies.anomalies_contextual(san(s, d))), "ok", f"SELECT run_id, {_SCORE} AS score FROM ok JOIN mad USING (report_name, hour) WHERE mad > 0 AND {_SCORE} > 5", "score", **_MAD("report_name, hour"))
register("anomalies_contextual_adaptive", lambda s, d: _PICK(anomalies.anomalies_contextual_adaptive(san(s, d))), "san", f"SELECT run_id, {_SCORE} AS score FROM (SELECT *, q[2] AS median, (q[3] - q[1]) / 1.349 AS mad FROM r WHERE c >= 5) WHERE mad > 0 AND execution_status = 'success' AND {_SCORE} > 5", "score", r=_ROLL(30))
_THR = "SELECT report_name, hour, median, CASE WHEN mad = 0 THEN CASE WHEN (SELECT avg(mad) FROM mad) > 0 THEN (SELECT avg(mad) FROM mad) ELSE 1.0 END ELSE mad END AS mad FROM mad"
register("context_thresholds", lambda s, d: anomalies.context_thresholds(san(s, d)), "ok", _THR, "median mad", **_MAD("report_name, hour", "ok"))
register("threshold_exceptions", lambda s, d: _PICK(anomalies.threshold_exceptions(san(s, d), anomalies.context_thresholds(san(s, d)))), "ok",
         "SELECT run_id, 0.6745 * abs(duration_seconds - median) / thr.mad AS score FROM san JOIN thr USING (report_name, hour) WHERE 0.6745 * abs(duration_seconds - median) / thr.mad > 3.5", "score", **_MAD("report_name, hour", "ok"), thr=_THR)
register("isolation_scores", lambda s, d: anomalies.isolation_scores(san(s, d)))
register("double_runs", lambda s, d: doubles(s, d).select("run_id", "previous_run", "report_name", "gap_seconds"), "dr", "SELECT run_id, previous_run, report_name, gap_seconds FROM dr")
register("double_runs_same_parameters", lambda s, d: anomalies.double_runs(san(s, d), 3600, True, True).select("run_id", "previous_run", "gap_seconds"), "san", """
    SELECT run_id, previous_run, gap AS gap_seconds FROM (SELECT run_id, lag(run_id) OVER w AS previous_run, date_diff('microsecond', lag(started_at) OVER w, started_at) // 1000000 AS gap FROM san
        WHERE execution_status IN ('success', 'cancelled') WINDOW w AS (PARTITION BY report_name, parameters ORDER BY started_at, run_id)) WHERE gap BETWEEN 0 AND 3600""")  # fmt: skip
register("double_run_summary", lambda s, d: anomalies.double_run_summary(doubles(s, d)), "dr", "SELECT count(*) AS pairs, count(DISTINCT report_name) AS reports, avg(gap_seconds) AS mean_gap_seconds FROM dr", "mean_gap_seconds")
register("double_run_offenders", lambda s, d: anomalies.double_run_offenders(doubles(s, d)), "dr", "SELECT report_name, count(*) AS pairs FROM dr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
register("severity", lambda s, d: anomalies.anomalies_global(san(s, d), 3).groupBy(fn.severity(F.col("score")).alias("severity")).agg(F.count("*").alias("n")), "ok",
         f"SELECT CASE WHEN s >= 7 THEN 'severe' WHEN s >= 5 THEN 'moderate' ELSE 'mild' END AS severity, count(*) AS n FROM (SELECT {_SCORE} AS s FROM ok JOIN mad USING (report_name) WHERE mad > 0 AND {_SCORE} > 3) GROUP BY 1", **_MAD("report_name"))
register("label_quality", lambda s, d: anomalies.label_quality(san(s, d).select(F.expr("CASE WHEN run_id % 10 < 5 THEN 'TP' WHEN run_id % 10 < 7 THEN 'FP' WHEN run_id % 10 < 8 THEN 'FN' ELSE 'TN' END").alias("verdict"))), "san", """
    SELECT *, 2 * precision * recall / (precision + recall + 0.00001) AS f1 FROM (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn + 0.0001) AS recall FROM (
        SELECT count_if(run_id % 10 < 5) AS tp, count_if(run_id % 10 IN (5, 6)) AS fp, count_if(run_id % 10 = 7) AS fn FROM san))""", "precision recall f1", ints="tp fp fn")  # fmt: skip

def _days(s, d, keys=("report_name",)):
    """Daily sketches of all runs, as a job stores them each night."""
    return stashed(s, "days", sketches.daily_sketches(san(s, d), keys))


register("report_features_of_days", lambda s, d: sketches.features_of_days(_days(s, d)))
register("quantile_drift_of_days", lambda s, d: sketches.drift_of_days(_days(s, d, ("report_type",)), ("report_type",)))
register("anomalies_of_days", lambda s, d: _PICK(sketches.anomalies_of_days(san(s, d), _days(s, d))))

# --- D: drift
register("drift_windows", lambda s, d: drift.drift_windows(san(s, d)).select("run_id", "side"), "win", "SELECT run_id, side FROM win")
_QD = ", ".join(f"quantile_cont(duration_seconds, {q}) FILTER (side = '{x}') AS {x}_p{p}" for x in "AB" for q, p in ((0.5, 50), (0.9, 90)))
register("quantile_drift", lambda s, d: drift.quantile_drift(san(s, d)), "win", f"""
    SELECT *, A_p50 - B_p50 AS delta_p50, A_p90 - B_p90 AS delta_p90, A_p90 / (B_p90 + 1e-9) AS ratio_p90 FROM (SELECT report_type, {_QD}, count_if(side = 'A') AS A_n, count_if(side = 'B') AS B_n FROM win GROUP BY 1)
    WHERE A_n > 0 AND B_n > 0""", "A_p50 A_p90 B_p50 B_p90 delta_p50 delta_p90 ratio_p90", ints="A_n B_n")  # fmt: skip
register("ks_statistic", lambda s, d: drift.ks_statistic(san(s, d)), "win", """
    SELECT report_type, n_a, n_b, max(abs(ca / n_a - cb / n_b)) AS ks FROM (
        SELECT report_type, sum(a) OVER p AS n_a, sum(b) OVER p AS n_b, sum(a) OVER w AS ca, sum(b) OVER w AS cb
        FROM (SELECT report_type, duration_seconds AS x, count_if(side = 'A') AS a, count_if(side = 'B') AS b FROM win GROUP BY ALL) WINDOW p AS (PARTITION BY report_type), w AS (PARTITION BY report_type ORDER BY x))
    WHERE n_a >= 3 AND n_b >= 3 GROUP BY ALL""", "ks", ints="n_a n_b")  # fmt: skip
register("ks_drift", lambda s, d: drift.ks_drift(san(s, d)))
register("psi", lambda s, d: drift.psi(san(s, d)), "win", """
    SELECT report_type, sum((x - e) * ln(x / e)) AS psi FROM (
        SELECT report_type, bin, greatest(coalesce(a, 0) / na, 1e-6) AS x, greatest(coalesce(b, 0) / nb, 1e-6) AS e
        FROM (SELECT report_type, na, nb, unnest(range(10)) AS bin FROM n) LEFT JOIN c USING (report_type, bin)) GROUP BY 1""", "psi",
         q="SELECT report_type, quantile_cont(duration_seconds, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM win WHERE side = 'B' GROUP BY 1",
         c="SELECT report_type, len([v FOR v IN q IF v < duration_seconds]) AS bin, count_if(side = 'A') AS a, count_if(side = 'B') AS b FROM win JOIN q USING (report_type) GROUP BY ALL",
         n="SELECT report_type, count_if(side = 'A') AS na, count_if(side = 'B') AS nb FROM win GROUP BY 1")

# --- E: evaluation
_PAIR = lambda y, p: f"avg(abs({y} - {p})) AS mae, sqrt(avg(({y} - {p}) * ({y} - {p}))) AS rmse"
register("error_metrics", lambda s, d: evaluate.error_metrics(series.naive_predictions(keyed(s, d), ["report_type"]), "report_count", "pred_last_hour", ["report_type"]), "kh",
         f"SELECT report_type, count(*) AS n, {_PAIR('report_count', 'p')} FROM (SELECT *, lag(report_count) OVER (PARTITION BY report_type ORDER BY timestamp_hour) AS p FROM kh) WHERE p IS NOT NULL GROUP BY 1", "mae rmse")
register("baseline_metrics", lambda s, d: evaluate.baseline_metrics(hourly(s, d)), "naive",
         " UNION ALL ".join(f"SELECT '{n}' AS baseline, count(*) AS rows, count(pred_{n}) AS n, {_PAIR('report_count', f'pred_{n}')} FROM naive" for n in ("last_hour", "last_week")), "mae rmse")
register("mase", lambda s, d: evaluate.mase(part(s, d, "train"), part(s, d, "test"), "report_count", "pred_last_week"), "train test", """
    SELECT mae, naive, mae / naive AS mase FROM (SELECT avg(abs(report_count - pred_last_week)) AS mae FROM test), (SELECT avg(abs(report_count - p)) AS naive FROM (SELECT *, lag(report_count) OVER (ORDER BY timestamp_hour) AS p FROM train))""", "mae naive mase")  # fmt: skip
register("holdout_report", lambda s, d: evaluate.holdout_report(split(s, d), pred="pred_last_week"), "sp", """
    SELECT n_test, mae, rmse, naive_mae, naive_rmse, high_volume_bias, mae / divisor AS mase, (naive_mae - mae) / naive_mae * 100 AS improvement_pct FROM (
        SELECT count_if(split = 'test') AS n_test, avg(abs(y - p)) FILTER (split = 'test') AS mae, sqrt(avg((y - p) * (y - p)) FILTER (split = 'test')) AS rmse, avg(abs(y - b)) FILTER (split = 'test') AS naive_mae,
               sqrt(avg((y - b) * (y - b)) FILTER (split = 'test')) AS naive_rmse, avg(abs(y - b)) FILTER (split = 'train') AS divisor, coalesce(avg(p - y) FILTER (split = 'test' AND y > 50), 0) AS high_volume_bias
        FROM (SELECT split, report_count AS y, pred_last_week AS p, pred_last_hour AS b FROM sp))""", "mae rmse naive_mae naive_rmse high_volume_bias mase improvement_pct", ints="n_test")  # fmt: skip
register("spike_metrics", lambda s, d: evaluate.spike_metrics(part(s, d, "test"), pred="pred_last_week"), "test", """
    SELECT count(*) AS n, avg(abs(report_count - pred_last_week)) AS spike_mae, avg(abs(report_count - pred_last_hour)) AS spike_mae_naive FROM test WHERE report_count > (SELECT quantile_cont(report_count, 0.75) FROM test)""", "spike_mae spike_mae_naive")  # fmt: skip
register("band_coverage", lambda s, d: evaluate.band_coverage(raw_forecast(s, d)), "fc", "SELECT avg(CAST(y_actual BETWEEN y_p10 AND y_p90 AS INTEGER)) * 100 AS coverage_pct, avg(y_p90 - y_p10) AS mean_width FROM fc", "coverage_pct mean_width")
register("horizon_eval", lambda s, d: evaluate.horizon_eval(raw_forecast(s, d).drop("y_actual"), hourly(s, d).select(F.col("timestamp_hour").alias("ds"), F.col("report_count").alias("y_actual"))), "fc", f"""
    SELECT count(*) AS n, {_PAIR('y_actual', 'y_pred')}, avg(y_pred - y_actual) AS bias, coalesce(avg(y_pred - y_actual) FILTER (y_actual > 50), 0) AS high_volume_bias,
           avg(CAST(y_actual BETWEEN y_p10 AND y_p90 AS INTEGER)) * 100 AS coverage_pct FROM fc HAVING count(*) >= 24""", "mae rmse bias high_volume_bias coverage_pct")  # fmt: skip
register("residuals", lambda s, d: evaluate.residual_histogram(part(s, d, "test"), "report_count", "y_pred"), "test", """
    SELECT least(floor((r - a) / ((b - a) / 20)), 19) AS bin, a + bin * ((b - a) / 20) AS low, a + (bin + 1) * ((b - a) / 20) AS high, count(*) AS n
    FROM (SELECT r, min(r) OVER () AS a, max(r) OVER () AS b FROM (SELECT report_count - y_pred AS r FROM test)) GROUP BY bin, a, b""", "low high", ints="bin")  # fmt: skip
register("residual_pairs", lambda s, d: evaluate.residuals(part(s, d, "test"), "report_count", "y_pred").select("timestamp_hour", "y_pred", "residual"), "test", "SELECT timestamp_hour, y_pred, report_count - y_pred AS residual FROM test", "y_pred residual", "timestamp_hour")
register("acf", lambda s, d: evaluate.acf(hourly(s, d), "report_count"), "h",
         " UNION ALL ".join(f"SELECT {k} AS lag, corr(x, l) AS acf FROM (SELECT report_count AS x, lag(report_count, {k}) OVER (ORDER BY timestamp_hour) AS l FROM h)" for k in range(1, 25)), "acf")
_FOLDS = """SELECT *, CASE WHEN i < n - (6 - fold) * (n // 6) THEN 'train' WHEN i < n - (6 - fold) * (n // 6) + n // 6 THEN 'test' END AS part
            FROM (SELECT *, row_number() OVER (ORDER BY timestamp_hour) - 1 AS i, count(*) OVER () AS n FROM naive) CROSS JOIN (SELECT unnest(range(1, 6)) AS fold)"""
register("walk_forward_folds", lambda s, d: evaluate.walk_forward_folds(hourly(s, d)).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min(TS).alias("first"), F.max(TS).alias("last")), "naive",
         "SELECT fold, part, count(*) AS n, min(timestamp_hour) AS first, max(timestamp_hour) AS last FROM folds WHERE part IS NOT NULL GROUP BY ALL", times="first last", folds=_FOLDS)
register("walk_forward_eval", lambda s, d: evaluate.walk_forward_eval(series.naive_predictions(hourly(s, d))), "naive", """
    SELECT fold, mae, mase, avg(mae) OVER () AS mae_mean, stddev_pop(mae) OVER () AS mae_std, avg(mase) OVER () AS mase_mean, stddev_pop(mase) OVER () AS mase_std FROM (
        SELECT fold, avg(abs(report_count - pred_last_hour)) FILTER (part = 'test') AS mae, mae / avg(abs(report_count - pred_last_hour)) FILTER (part = 'train') AS mase FROM folds GROUP BY fold)""", "mae mase mae_mean mae_std mase_mean mase_std", folds=_FOLDS)  # fmt: skip
register("rolling_origin", lambda s, d: evaluate.rolling_origin(hourly(s, d)), "h", f"""
    SELECT step, count(*) AS n, {_PAIR('y', 'p')} FROM (
        SELECT step, a.report_count AS y, b.report_count AS p FROM (SELECT cut, unnest(range(1, 25)) AS step FROM (SELECT unnest(range(336, (SELECT count(*) FROM h) - 24 + 1, 72)) AS cut)) c
        JOIN r a ON a.i = cut + step JOIN r b ON b.i = cut - 24 + step) GROUP BY step""", "mae rmse", r="SELECT *, row_number() OVER (ORDER BY timestamp_hour) AS i FROM h")  # fmt: skip
register("hit_labels", lambda s, d: hits(s, d), "hits", "SELECT * FROM hits", "pred score")
_ROC = """SELECT model, score, sum(p) OVER w / sum(p) OVER (PARTITION BY model) AS tpr, sum(n) OVER w / CASE WHEN sum(n) OVER (PARTITION BY model) > 0 THEN sum(n) OVER (PARTITION BY model) END AS fpr
          FROM (SELECT model, score, sum(hit) AS p, sum(1 - hit) AS n FROM hits GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY score DESC)"""
register("roc_curve", lambda s, d: evaluate.roc_curve(hits(s, d), keys=["model"]), "hits", _ROC, "score tpr fpr")
register("auc", lambda s, d: evaluate.auc(evaluate.roc_curve(hits(s, d), keys=["model"]), keys=["model"]), "hits", """
    SELECT model, sum(area) AS auc FROM (SELECT model, (fpr - coalesce(lag(fpr) OVER w, 0)) * (tpr + coalesce(lag(tpr) OVER w, 0)) / 2 AS area FROM roc WINDOW w AS (PARTITION BY model ORDER BY score DESC)) GROUP BY 1""", "auc", roc=_ROC)  # fmt: skip
register("confusion", lambda s, d: evaluate.confusion(hits(s, d)), "hits", """
    SELECT actual, predicted, count(hit) AS n FROM (SELECT unnest([0, 0, 1, 1]) AS actual, unnest([0, 1, 0, 1]) AS predicted) LEFT JOIN hits ON hit = actual AND CAST(score >= 0.5 AS INTEGER) = predicted GROUP BY ALL""")  # fmt: skip
register("class_report", lambda s, d: evaluate.class_report(hits(s, d)), "hits", """
    SELECT *, coalesce(2 * precision * recall / CASE WHEN precision + recall > 0 THEN precision + recall END, 0) AS f1 FROM (
        SELECT *, coalesce(tp / CASE WHEN tp + fp > 0 THEN tp + fp END, 0) AS precision, coalesce(tp / CASE WHEN tp + fn > 0 THEN tp + fn END, 0) AS recall FROM (
            SELECT model, count_if(score >= 0.5 AND hit = 1) AS tp, count_if(score >= 0.5 AND hit = 0) AS fp, count_if(score < 0.5 AND hit = 1) AS fn FROM hits GROUP BY 1))""", "precision recall f1", ints="tp fp fn")  # fmt: skip
register("mase_band", lambda s, d: evaluate.walk_forward_eval(series.naive_predictions(hourly(s, d))).select("fold", fn.mase_band(F.col("mase")).alias("band")), "naive", """
    SELECT fold, CASE WHEN mase < 1 THEN 'better' WHEN mase <= 1.1 THEN 'similar' ELSE 'worse' END AS band FROM (
        SELECT fold, avg(abs(report_count - pred_last_hour)) FILTER (part = 'test') / avg(abs(report_count - pred_last_hour)) FILTER (part = 'train') AS mase FROM folds GROUP BY fold)""", folds=_FOLDS)  # fmt: skip

# --- F: calibration, forecasts, planning
_BIAS = "SELECT hour, coalesce(round(quantile_cont(y - y_pred, 0.5), 4), 0) AS value FROM (SELECT unnest(range(24)) AS hour) LEFT JOIN test USING (hour) GROUP BY 1"
_FLOOR = "SELECT hour, CASE WHEN quantile_cont(y, 0.75) > 0 THEN round(quantile_cont(y, 0.25), 2) ELSE 0 END AS value FROM train GROUP BY 1"
_SPIKE = """SELECT hour, threshold, round(avg(y), 2) AS spike_mean, (SELECT round(avg(y), 2) FROM train WHERE y > (SELECT quantile_cont(y, 0.75) FROM train)) AS overall_mean
            FROM train, (SELECT quantile_cont(y, 0.75) AS threshold FROM train) WHERE y > threshold GROUP BY ALL"""
_TAIL = "SELECT *, hour(timestamp_hour) AS hour, isodow(timestamp_hour) - 1 AS weekday FROM {0} QUALIFY row_number() OVER (ORDER BY timestamp_hour DESC) <= 672"
_SEASON = """SELECT weekday, hour, coalesce(c, m, 0) AS seasonal FROM (SELECT w AS weekday, x AS hour FROM range(7) a(w) CROSS JOIN range(24) b(x))
             LEFT JOIN (SELECT weekday, hour, avg(report_count) AS c FROM tail GROUP BY ALL) USING (weekday, hour) LEFT JOIN (SELECT hour, avg(report_count) AS m FROM tail GROUP BY ALL) USING (hour)"""
register("sample_weights", lambda s, d: forecast.sample_weights(part(s, d, "train")).select(TS, "weight"), "train", "SELECT timestamp_hour, greatest(y * y / (SELECT avg(y * y) FROM train), 1) AS weight FROM train", "weight", TS)
register("hourly_bias", lambda s, d: forecast.hourly_bias(part(s, d, "test")), "test", _BIAS, "value")
register("hourly_floor", lambda s, d: forecast.hourly_floor(part(s, d, "train")), "train", _FLOOR, "value")
register("spike_profile", lambda s, d: forecast.spike_profile(part(s, d, "train")), "train", _SPIKE, "threshold spike_mean overall_mean")
register("seasonal_table", lambda s, d: forecast.seasonal_table(hourly(s, d)), "h", _SEASON, "seasonal", tail=_TAIL.format("h"))
register("trend_tail", lambda s, d: forecast.trend_tail(keyed(s, d), "report_count", keys=["report_type"]), "kh", """
    SELECT report_type, step, greatest(last + slope * step, 0) AS projected FROM (SELECT report_type, regr_slope(y, i) AS slope, arg_max(y, i) AS last FROM (
        SELECT *, report_count AS y, row_number() OVER (PARTITION BY report_type ORDER BY timestamp_hour) AS i FROM kh QUALIFY row_number() OVER (PARTITION BY report_type ORDER BY timestamp_hour DESC) <= 24) GROUP BY 1), (SELECT unnest(range(1, 25)) AS step)""", "projected")  # fmt: skip
register("future_grid", lambda s, d: forecast.future_grid(hourly(s, d), hol(s)).select(TS, "step", "hour", "weekday", "is_weekend", "hour_sin", "fourier_weekly_cos_3"), "h", """
    SELECT ts AS timestamp_hour, step, hour(ts) AS hour, isodow(ts) - 1 AS weekday, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, sin(hour(ts) * 2 * pi() / 24) AS hour_sin, cos(t * 3 * 2 * pi() / 168) AS fourier_weekly_cos_3
    FROM (SELECT last + to_hours(step + 1) AS ts, step, date_diff('hour', first, last) + step + 1 AS t FROM (SELECT min(timestamp_hour) AS first, max(timestamp_hour) AS last FROM h), (SELECT CAST(unnest(range(312)) AS INTEGER) AS step))""", "hour_sin fourier_weekly_cos_3", TS)  # fmt: skip


def stashed(s, name, df):
    """df written to the shared folder and read again: what several branches of a query need is made once."""
    path = _shared(s, name)
    df.write.parquet(path)
    return s.read.schema(df.schema).parquet(path)


def _features(s, d):
    return series.enrich_hourly(stashed(s, "hourly", hourly(s, d)), san(s, d), hol(s))


def _halves(s, d):
    df = stashed(s, "split", series.temporal_split(_features(s, d)))  # a fit goes through its rows many times
    return df.filter("split = 'train'"), df.filter("split = 'test'")


def _series_halves(s, d):
    """The keyed series with features that need no other table, in train and test parts."""
    keys = ["report_type"]
    h = stashed(s, "keyed", keyed(s, d))
    df = series.lag_features(series.rolling_features(series.calendar_features(h, hol(s)), keys), keys)
    df = stashed(s, "features", series.temporal_split(df, keys))
    return df.filter("split = 'train'"), df.filter("split = 'test'")


SERIES_FEATURES = ("hour", "weekday", "is_weekend", "is_holiday", "is_peak_hour", "y_lag_1", "y_lag_2", "y_lag_3", "y_lag_24", "y_lag_168", "y_rolling_mean_3", "y_rolling_mean_24", "y_rolling_mean_168", "y_rolling_std_24")


def _by_series(s, d):
    train, test = _series_halves(s, d)
    return forecast.score_by_series(train, test, ["report_type"], SERIES_FEATURES).select("report_type", TS, "report_count", "y_pred", "p_spike")


def _point(s, d):
    train, test = _halves(s, d)
    return forecast.score_point_model(forecast.fit_point_model(train), test).select(TS, "report_count", "y_pred")


def _spikes(s, d):
    train, test = _halves(s, d)
    return forecast.spike_probability(train, test).select(TS, "report_count", "p_spike")


def _scenario(s, d):
    train, test = _halves(s, d)
    return forecast.scenario(forecast.fit_point_model(train), test, {"is_holiday": 1.0, "backlog": 500.0}).select(TS, "y_pred")


def adjusted(s, d):
    df = stashed(s, "split", split(s, d)).withColumns({"y": F.col("report_count"), "y_pred": F.col("pred_last_hour").cast("double"), "hour": F.hour(TS)})
    train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
    return forecast.adjust_forecast(raw_of(test), forecast.hourly_bias(test), forecast.hourly_floor(train), forecast.spike_profile(train), forecast.seasonal_table(train))


_ADJ = {
    "bias": _BIAS, "flr": _FLOOR, "spk": _SPIKE, "tail": _TAIL.format("train").replace("*, hour(timestamp_hour) AS hour", "*"), "season": _SEASON,
    "a0": """SELECT ds, step, p_spike, hour BETWEEN 8 AND 18 AND weekday < 5 AS busy, coalesce(bias.value, 0) AS b, coalesce(flr.value, 0) AS f, coalesce(spike_mean, (SELECT max(overall_mean) FROM spk), 0) AS sm,
             (1 - least(0.4, step / 168.0 * 0.4)) * y_p50 + least(0.4, step / 168.0 * 0.4) * coalesce(seasonal, 0) AS y, y_p10 AS lo, y_p90 AS hi
             FROM fc LEFT JOIN season USING (weekday, hour) LEFT JOIN bias USING (hour) LEFT JOIN flr USING (hour) LEFT JOIN spk USING (hour)""",
    "a1": "SELECT * REPLACE (greatest(y + b, 0) AS y, greatest(lo + b, 0) AS lo, greatest(hi + b, 0) AS hi) FROM a0",
    "a2": "SELECT * REPLACE (CASE WHEN busy THEN greatest(y, f) ELSE y END AS y, CASE WHEN busy THEN greatest(lo, f) ELSE lo END AS lo, CASE WHEN busy THEN greatest(hi, f) ELSE hi END AS hi) FROM a1",
    "a3": "SELECT * REPLACE (CASE WHEN p_spike >= 0.5 AND busy THEN 0.5 * y + 0.5 * sm ELSE y END AS y) FROM a2",
    "a4": "SELECT * REPLACE (CASE WHEN p_spike >= 0.5 THEN greatest(y - (hi - lo) / 2 * 1.2, 0) ELSE lo END AS lo, CASE WHEN p_spike >= 0.5 THEN y + (hi - lo) / 2 * 1.2 ELSE hi END AS hi) FROM a3",
    "adj": "SELECT ds, step, greatest(y - h, 0) AS y_p10, y AS y_pred, y + h AS y_p90 FROM (SELECT *, (hi - lo) / 2 * greatest(1, sqrt((step + 1) / 24.0)) AS h FROM a4)",
}
BANDS = "y_p10 y_pred y_p90"
register("fit_point_model", _point)
register("quantile_bands", lambda s, d: forecast.quantile_bands(part(s, d, "test"), part(s, d, "train").filter("y_pred is not null")).select(TS, "y_pred", "y_p10", "y_p90"), "train test", """
    SELECT timestamp_hour, y_pred, greatest(y_pred + q[1], 0) AS y_p10, greatest(y_pred + q[2], 0) AS y_p90 FROM test JOIN (SELECT hour, quantile_cont(y - pred_last_hour, [0.025, 0.975]) AS q FROM train WHERE pred_last_hour IS NOT NULL GROUP BY 1) USING (hour)""", BANDS, TS)  # fmt: skip
register("spike_probability", _spikes)
register("adjust_forecast", lambda s, d: adjusted(s, d), "fc train test", "SELECT ds, step, round(y_p10, 2) AS y_p10, round(y_pred, 2) AS y_pred, round(y_p90, 2) AS y_p90 FROM adj", BANDS, "ds", **_ADJ)
register("series_models", _by_series)
HOLIDAYS = ["2024-01-01", "2024-01-15"]


def _recursive_input(s, d):
    """The keyed series with backlog and type code, and the maps of its naive forecast's errors."""
    keys = ["report_type"]
    h = stashed(s, "keyed", keyed(s, d))
    types = h.groupBy("report_type").agg(F.min(TS).alias("first")).select("report_type", F.pmod(F.xxhash64("report_type"), F.lit(1000)).cast("double").alias("type_code"))
    spans = san(s, d).groupBy("report_type", F.date_trunc("hour", "started_at").alias(TS)).agg(F.avg(series.span_any(F.col("parameters"))).alias("avg_param_span_days"))
    rows = h.join(joins.backlog_running(ex(s, d), h, keys), [*keys, TS]).join(spans, [*keys, TS], "left").join(types, keys).fillna(0.0, "avg_param_span_days")
    pred = series.naive_predictions(h, keys).withColumnRenamed("pred_last_week", "y_pred").filter("y_pred is not null")
    return rows, forecast.series_maps(h, pred, keys)


def _recursive(s, d):
    rows, maps = _recursive_input(s, d)
    return forecast.recursive_forecast(rows, 48, ["report_type"], HOLIDAYS, maps=maps, extra=["backlog", "avg_param_span_days"], held={"type_code": None}, spike_trees=10)


def _horizon(s, d):
    """The planning variant: a week's buffer, constant backlog, working days after free ones raised before they are fed back."""
    rows, maps = _recursive_input(s, d)
    return forecast.recursive_forecast(rows, 312, ["report_type"], HOLIDAYS, buffer=168, maps=maps, held={"backlog": 20.0}, trees=40, spike_trees=10, short="last", return_pct=0.1)


register("recursive_forecast", _recursive)
register("horizon_forecast", _horizon)
_RTW = """SELECT ds, step, least(p10, p50) AS y_p10, p50 AS y_pred, greatest(p50, p90) AS y_p90 FROM (
              SELECT ds, step, y_p10 * g AS p10, y_pred * g AS p50, y_p90 * g AS p90 FROM (
                  SELECT *, CASE WHEN NOT off0 AND off1 THEN 1.1 ELSE 1 END AS g FROM (
                      SELECT ds, step, y_p10, y_pred, y_p90, isodow(ds) >= 6 OR CAST(ds AS DATE) IN (SELECT date FROM hol) AS off0,
                             isodow(ds - INTERVAL 1 DAY) >= 6 OR CAST(ds - INTERVAL 1 DAY AS DATE) IN (SELECT date FROM hol) AS off1 FROM fc)))"""
register("return_to_work", lambda s, d: forecast.return_to_work(raw_forecast(s, d).select("ds", "step", *BANDS.split()), hol(s)), "fc hol", _RTW, BANDS, "ds")
_DAILY = "SELECT CAST(ds AS DATE) AS date, sum(y_p10) AS y_p10, sum(y_pred) AS y_pred, sum(y_p90) AS y_p90 FROM fc GROUP BY 1"


def daily(s, d):
    return forecast.daily_rollup(raw_forecast(s, d))


register("daily_rollup", lambda s, d: daily(s, d), "fc", _DAILY, BANDS, dates="date")
register("capacity_kpis", lambda s, d: forecast.capacity_kpis(daily(s, d), part(s, d, "train").groupBy(F.to_date(TS).alias("date")).agg(F.sum("report_count").alias("y"))), "fc train", """
    SELECT peak, stress_peak, mean, total, history_max, history_p90, (mean - m) / m * 100 AS delta_pct FROM (SELECT max(y_pred) AS peak, max(y_p90) AS stress_peak, avg(y_pred) AS mean, sum(y_pred) AS total FROM daily),
        (SELECT avg(y) AS m, max(y) AS history_max, quantile_cont(y, 0.9) AS history_p90 FROM hist)""", "peak stress_peak mean total history_p90 delta_pct", ints="history_max",
         daily=_DAILY, hist="SELECT CAST(timestamp_hour AS DATE) AS date, CAST(sum(report_count) AS BIGINT) AS y FROM train GROUP BY 1")
register("peak_days", lambda s, d: forecast.peak_days(daily(s, d)), "fc", "SELECT * FROM daily ORDER BY y_pred DESC, date LIMIT 3", BANDS, dates="date", daily=_DAILY)
register("structural_components", lambda s, d: forecast.structural_components(hourly(s, d)), "h", """
    SELECT date, avg(trend) AS trend, avg(weekly) AS weekly, avg(daily) AS daily FROM (SELECT *, avg(report_count - trend - weekly) OVER (PARTITION BY h) AS daily FROM (
        SELECT *, avg(report_count - trend) OVER (PARTITION BY w) AS weekly FROM (
            SELECT CAST(timestamp_hour AS DATE) AS date, isodow(timestamp_hour) AS w, hour(timestamp_hour) AS h, report_count, avg(report_count) OVER (ORDER BY timestamp_hour ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING) AS trend FROM h))) GROUP BY 1""", "trend weekly daily", dates="date")  # fmt: skip
register("scenario", _scenario)
_FOLD_METRICS = lambda s, d: evaluate.walk_forward_eval(series.naive_predictions(hourly(s, d))).select(F.col("fold").alias("config_index"), "mae", "mase")
register("best_config", lambda s, d: forecast.best_config(_FOLD_METRICS(s, d), 1.0), "naive", """
    SELECT config_index, mae, mase, mase <= 1.0 AS promote FROM (SELECT fold AS config_index, avg(abs(report_count - pred_last_hour)) FILTER (part = 'test') AS mae,
        mae / avg(abs(report_count - pred_last_hour)) FILTER (part = 'train') AS mase FROM folds GROUP BY 1) ORDER BY mase, config_index LIMIT 1""", "mae mase", folds=_FOLDS)  # fmt: skip

CONFIGS = [{"ridge": 0.1}, {"ridge": 1.0}, {"ridge": 30.0}, {"trees": 20, "depth": 2, "rate": 0.2}, {"trees": 40, "depth": 3, "rate": 0.2}, {"trees": 40, "depth": 3, "rate": 0.1}]


def _searched(s, d):
    return backtest.grid_search(stashed(s, "hourly", hourly(s, d)), CONFIGS, 5, holidays=HOLIDAYS)


register("walk_forward_refit", lambda s, d: backtest.walk_forward_refit(stashed(s, "keyed", keyed(s, d)), keys=["report_type"], holidays=HOLIDAYS))
register("rolling_origin_refit", lambda s, d: backtest.errors_by_step(backtest.rolling_origin_refit(keyed(s, d), keys=["report_type"], holidays=HOLIDAYS), ["report_type"]))
register("grid_search", lambda s, d: backtest.config_metrics(_searched(s, d)))
register("grid_search_best", lambda s, d: forecast.best_config(backtest.config_metrics(_searched(s, d)), 1.0))

# --- Q: queues
_BANDED = "mean_seconds median_seconds p95_seconds failure_rate cancel_rate"


def banded(s, d):
    return queues.queue_bands(rollups.report_features(san(s, d)))


register("queue_bands", lambda s, d: banded(s, d), "banded", "SELECT * FROM banded", _BANDED, ints="successes failures cancellations")
register("knn_assign", lambda s, d: queues.knn_assign(banded(s, d)))
register("knn_accuracy", lambda s, d: queues.knn_accuracy(queues.knn_assign(banded(s, d))))
register("knn_queue_table", lambda s, d: queues.queue_table(queues.knn_assign(banded(s, d))))
register("queue_profile", lambda s, d: queues.queue_profile(banded(s, d)), "banded", "SELECT band, count(*) AS reports, avg(mean_seconds) AS mean_seconds, avg(median_seconds) AS median_seconds, avg(p95_seconds) AS p95_seconds, avg(failure_rate) AS failure_rate FROM banded GROUP BY 1", "mean_seconds median_seconds p95_seconds failure_rate")
register("queue_table", lambda s, d: queues.queue_table(banded(s, d).withColumn("assigned", F.col("band"))), "banded", "SELECT report_id, report_name, queue_id, band, band AS assigned, p95_seconds FROM banded", "p95_seconds")


# --- A and R: files and streams, written and read in the shared folder
def _shared(s, name):
    import tempfile
    import uuid

    base = s.conf.get("spark.checkpoint.dir", None) or (f"file://{tempfile.mkdtemp(prefix='spark-')}" if s.sparkContext.master.startswith("local") else None)
    if base is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _extracts(s, d):
    path = _shared(s, "extracts")
    runs.write_extracts({"critical_reports": rollups.critical_reports(san(s, d)), "day_hour_load": rollups.day_hour_load(san(s, d))}, path)
    return s.read.parquet(f"{path}/critical_reports")


def _hour_map(s, d):
    path = _shared(s, "hours")
    runs.write_hour_map(forecast.hourly_floor(part(s, d, "train")), path)
    return runs.read_hour_map(s, path)


def _runs_csv(s, d):
    path = _shared(s, "runs")
    rows = ex(s, d).select("run_id", "report_name", "report_type", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("creation_date", "started_at", "completed_at")), "parameters")
    rows.write.csv(path, header=True)
    return runs.read_runs_csv(s, path).select(F.col("run_id").cast("long").alias("run_id"), "started_at", "completed_at")


def _hourly_csv(s, d):
    path = _shared(s, "hourly")
    hourly(s, d).select(F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias(TS), F.when(F.col("report_count") > 0, F.col("report_count")).alias("report_count")).write.csv(path, header=True)
    return runs.read_hourly_csv(s, path)


def _in_turn(s, path):
    """Give the files of a folder times of change in the order of their names: a stream takes them in that order."""
    folder = s._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(s._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    last = max((fs.getFileStatus(f).getModificationTime() for f in files), default=0)
    for i, f in enumerate(files):
        fs.setTimes(f, last + (i - len(files)) * 1000, -1)


def _streamed(s, d, job, mode):
    """Run a stream of all executions, in files by time, to its end."""
    source, out = _shared(s, "stream"), _shared(s, "out")
    rows = ex(s, d).select("run_id", "report_name", "execution_status", "started_at")
    rows.repartitionByRange(8, "started_at").write.parquet(source)
    _in_turn(s, source)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)  # so that state passes from batch to batch
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        job(stream).writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", _shared(s, "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(key, before)
    return s.read.parquet(out)


register("write_extracts", _extracts, "ok", "SELECT report_name, count(*) AS runs, avg(duration_seconds) AS mean_seconds, sum(duration_seconds) AS total_seconds, stddev_samp(duration_seconds) AS std_seconds FROM ok GROUP BY 1", "mean_seconds std_seconds", ints="total_seconds")
register("hour_map", _hour_map, "train", _FLOOR, "value")
register("read_runs_csv", _runs_csv, "ex", "SELECT run_id, started_at, completed_at FROM ex", times="started_at completed_at")
register("read_hourly_csv", _hourly_csv, "h", "SELECT * FROM h", "report_count", TS)
_CLOSED = "SELECT date_trunc('hour', started_at) AS timestamp_hour, count(*) AS report_count FROM ex GROUP BY 1 HAVING date_trunc('hour', min(started_at)) + INTERVAL 1 HOUR <= (SELECT max(started_at) FROM ex) - INTERVAL 2 HOUR"
register("stream_hourly_counts", lambda s, d: _streamed(s, d, jobs.stream_hourly_counts, "append"), "ex", _CLOSED, times=TS)
register("stream_double_runs", lambda s, d: _streamed(s, d, jobs.stream_double_runs, "append"), "ex", """
    SELECT report_name, run_id, previous_run, gap AS gap_seconds FROM (SELECT report_name, run_id, lag(run_id) OVER w AS previous_run, date_diff('microsecond', lag(started_at) OVER w, started_at) // 1000000 AS gap FROM ex
        WHERE execution_status = 'success' WINDOW w AS (PARTITION BY report_name ORDER BY started_at, run_id)) WHERE gap BETWEEN 0 AND 60""")
