"""SQL for the registered queries: shared tables as CTEs, and a wrapper for comparable values."""

from __future__ import annotations

CTE = {
    "runs": """
        SELECT event_id AS run_id, user_id, user_id AS report_id, ts - to_seconds((event_id * 37) % 7200) AS creation_date, ts AS started_at,
               CASE WHEN event_id % 97 <> 0 THEN ts + to_milliseconds(CAST(round(value * 1000) AS BIGINT)) END AS completed_at,
               event_type = 'error' AS failed, event_type = 'signup' AND event_id % 2 = 0 AS cancelled,
               CASE WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 'timeout' END AS error_message,
               CASE event_id % 4
                   WHEN 0 THEN 'startDate=2024-01-01&endDate=' || strftime(DATE '2024-01-01' + CAST(event_id % 90 AS INTEGER), '%Y-%m-%d')
                   WHEN 1 THEN '{"startDate": "2024-01-01", "endDate": "' || strftime(DATE '2024-01-01' + CAST(event_id % 90 AS INTEGER), '%Y-%m-%d') || '"}'
                   WHEN 2 THEN 'desde 01/01/2024 hasta ' || strftime(DATE '2024-01-01' + CAST(event_id % 90 AS INTEGER), '%d/%m/%Y') END AS parameters
        FROM events""",
    "reports": """
        SELECT p_partkey AS report_id, trim(p_name) AS report_name, 'reports/' || p_brand AS action_path, p_size % 5 AS queue_id,
               CASE WHEN p_partkey % 20 = 0 THEN 'Yes' ELSE '0' END AS deprecated, CASE WHEN p_partkey % 33 = 0 THEN 'TRUE' ELSE 'n' END AS deleted
        FROM part""",
    "queues": "SELECT r_regionkey AS queue_id, trim(r_name) AS report_type, ['S', 'M', 'L', 'XL', 'XL'][r_regionkey + 1] AS report_size FROM region",
    "ex": """
        SELECT run_id, user_id, creation_date, started_at, completed_at, date_diff('second', started_at, completed_at) AS duration_seconds,
               CASE WHEN cancelled THEN 'cancelled' WHEN failed OR error_message IS NOT NULL THEN 'failed' ELSE 'success' END AS execution_status,
               report_id, report_name, report_type, report_size, queue_id, action_path, parameters, deprecated, deleted
        FROM runs JOIN reports USING (report_id) JOIN queues USING (queue_id)""",
    "tf": "SELECT *, CAST(started_at AS DATE) AS date, hour(started_at) AS hour, isodow(started_at) - 1 AS weekday FROM ex",
    "san": "SELECT * FROM tf WHERE duration_seconds > 0 AND duration_seconds < 21600",
    "ok": "SELECT * FROM san WHERE execution_status = 'success'",
    "valid": "SELECT * FROM san WHERE execution_status = 'success' AND deprecated = '0' AND deleted = 'n'",
    "cnt": "SELECT date_trunc('hour', started_at) AS timestamp_hour, count(*) AS report_count FROM san GROUP BY 1",
    "grid": "SELECT unnest(generate_series((SELECT min(timestamp_hour) FROM cnt), (SELECT max(timestamp_hour) FROM cnt), INTERVAL 1 HOUR)) AS timestamp_hour",
    "h": "SELECT timestamp_hour, coalesce(report_count, 0) AS report_count FROM grid LEFT JOIN cnt USING (timestamp_hour)",
    "hol": "SELECT unnest([DATE '2024-01-01', DATE '2024-01-15']) AS date",
    "kcnt": "SELECT report_type, date_trunc('hour', started_at) AS timestamp_hour, count(*) AS report_count FROM san GROUP BY ALL",
    "kgrid": "SELECT report_type, unnest(generate_series(min(timestamp_hour), max(timestamp_hour), INTERVAL 1 HOUR)) AS timestamp_hour FROM kcnt GROUP BY report_type",
    "kh": "SELECT report_type, timestamp_hour, coalesce(report_count, 0) AS report_count FROM kgrid LEFT JOIN kcnt USING (report_type, timestamp_hour)",
    "naive": "SELECT *, lag(report_count, 1) OVER w AS pred_last_hour, lag(report_count, 168) OVER w AS pred_last_week FROM h WINDOW w AS (ORDER BY timestamp_hour)",
    "sp": "SELECT *, CASE WHEN row_number() OVER (ORDER BY timestamp_hour) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM naive",
    "train": "SELECT *, report_count AS y, hour(timestamp_hour) AS hour FROM sp WHERE split = 'train'",
    "test": "SELECT *, report_count AS y, CAST(pred_last_hour AS DOUBLE) AS y_pred, hour(timestamp_hour) AS hour FROM sp WHERE split = 'test'",
    "fc": """
        SELECT timestamp_hour AS ds, row_number() OVER (ORDER BY timestamp_hour) - 1 AS step, hour, isodow(timestamp_hour) - 1 AS weekday, report_count AS y_actual,
               0.7131 * pred_last_hour AS y_p10, CAST(pred_last_hour AS DOUBLE) AS y_p50, CAST(pred_last_hour AS DOUBLE) AS y_pred, 1.3873 * pred_last_hour AS y_p90,
               CASE WHEN pred_last_week > pred_last_hour THEN 0.6 ELSE 0.3 END AS p_spike FROM test""",
    "win": """
        SELECT *, CASE WHEN date_diff('day', date, m) < 7 THEN 'A' WHEN date_diff('day', date, m) < 37 THEN 'B' END AS side
        FROM (SELECT *, max(date) OVER () AS m FROM san) WHERE date_diff('day', date, m) < 37""",
    "feat": """
        SELECT report_id, report_name, report_type, queue_id, count(*) AS runs, count_if(execution_status = 'success') AS successes, count_if(execution_status = 'failed') AS failures,
               count_if(execution_status = 'cancelled') AS cancellations, coalesce(avg(duration_seconds) FILTER (execution_status = 'success'), 0) AS mean_seconds,
               coalesce(quantile_cont(duration_seconds, 0.5) FILTER (execution_status = 'success'), 0) AS median_seconds,
               coalesce(quantile_cont(duration_seconds, 0.95) FILTER (execution_status = 'success'), 0) AS p95_seconds,
               count_if(execution_status = 'failed') / count(*) AS failure_rate, count_if(execution_status = 'cancelled') / count(*) AS cancel_rate
        FROM san GROUP BY ALL""",
    "banded": """
        SELECT f.* EXCLUDE (q, n), CASE WHEN p95_seconds <= q[1] THEN 'S' WHEN p95_seconds <= q[2] THEN 'M' WHEN p95_seconds <= q[3] THEN 'L' ELSE 'XL' END AS band
        FROM (SELECT *, (SELECT quantile_cont(p95_seconds, [0.25, 0.5, 0.75]) FROM feat WHERE runs >= 20) AS q, count(*) OVER () AS n FROM feat WHERE runs >= 20) f WHERE n >= 8""",
    "dr": """
        SELECT *, date_diff('microsecond', previous_start, started_at) // 1000000 AS gap_seconds FROM (
            SELECT *, lag(run_id) OVER w AS previous_run, lag(started_at) OVER w AS previous_start FROM ok WINDOW w AS (PARTITION BY report_name ORDER BY started_at, run_id))
        WHERE date_diff('microsecond', previous_start, started_at) // 1000000 BETWEEN 0 AND 60""",
    "hits": """
        SELECT model, y, pred, CAST(abs(y - pred) < 30 AS INTEGER) AS hit, CASE WHEN max(abs(y - pred)) OVER () > 0 THEN 1 - abs(y - pred) / max(abs(y - pred)) OVER () ELSE 1 END AS score
        FROM (SELECT 'pred_last_hour' AS model, report_count AS y, CAST(pred_last_hour AS DOUBLE) AS pred FROM naive
              UNION ALL SELECT 'pred_last_week', report_count, CAST(pred_last_week AS DOUBLE) FROM naive) WHERE pred IS NOT NULL""",
    "cal": """
        SELECT timestamp_hour, report_count, hour(timestamp_hour) AS hour, isodow(timestamp_hour) - 1 AS weekday, day(timestamp_hour) AS day_of_month, month(timestamp_hour) AS month,
               CAST(isodow(timestamp_hour) >= 6 AS INTEGER) AS is_weekend, CAST(hour(timestamp_hour) BETWEEN 8 AND 18 AS INTEGER) AS is_peak_hour,
               CAST(CAST(timestamp_hour AS DATE) IN (SELECT date FROM hol) AS INTEGER) AS is_holiday, CAST(last_day(timestamp_hour) = CAST(timestamp_hour AS DATE) AS INTEGER) AS is_month_end FROM h""",
    "lagged": """
        SELECT timestamp_hour, report_count, lag(report_count, 1, 0) OVER w AS y_lag_1, lag(report_count, 2, 0) OVER w AS y_lag_2, lag(report_count, 3, 0) OVER w AS y_lag_3,
               lag(report_count, 24, 0) OVER w AS y_lag_24, lag(report_count, 168, 0) OVER w AS y_lag_168 FROM h WINDOW w AS (ORDER BY timestamp_hour)""",
    "rolled": "SELECT *, " + ", ".join(
        f"coalesce(CASE WHEN count(*) OVER (ORDER BY timestamp_hour ROWS {n - 1} PRECEDING) = {n} THEN {f}(y_lag_1) OVER (ORDER BY timestamp_hour ROWS {n - 1} PRECEDING) END, 0) AS y_rolling_{name}_{n}"
        for name, f, sizes in (("mean", "avg", (3, 24, 168)), ("std", "stddev_samp", (3, 24))) for n in sizes
    ) + " FROM lagged",
    "back": """
        SELECT timestamp_hour, (SELECT count(*) FROM san WHERE creation_date <= g.timestamp_hour) - (SELECT count(*) FROM san WHERE started_at <= g.timestamp_hour) AS backlog FROM grid g""",
    "keyed": r"""
        SELECT date_trunc('hour', started_at) AS timestamp_hour, avg(span) AS avg_param_span_days FROM (
            SELECT started_at, date_diff('day', TRY_CAST(regexp_extract(parameters, '(?i)(?:start_?date|fechainicio)[":\s=>]*["'']?(\d{4}-\d{2}-\d{2})', 1) AS DATE),
                                         TRY_CAST(regexp_extract(parameters, '(?i)(?:end_?date|fechafin)[":\s=>]*["'']?(\d{4}-\d{2}-\d{2})', 1) AS DATE)) AS span FROM san)
        WHERE span BETWEEN 0 AND 3650 GROUP BY 1""",
}
#: What each table reads.
NEEDS = {
    "ex": "runs reports queues", "tf": "ex", "san": "tf", "ok": "san", "valid": "san", "cnt": "san", "grid": "cnt", "h": "grid", "kcnt": "san", "kgrid": "kcnt", "kh": "kgrid", "naive": "h", "sp": "naive", "train": "sp",
    "test": "sp", "fc": "test", "win": "san", "feat": "san", "banded": "feat", "dr": "ok", "hits": "naive", "cal": "h hol", "lagged": "h", "rolled": "lagged", "back": "grid", "keyed": "san",
}


def query(tables: str, body: str, **own: str) -> str:
    """A query over shared tables, with further CTEs of its own in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, "").split():
            add(need)
        if name not in order:
            order.append(name)

    for name in tables.split():
        add(name)
    ctes = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({x})" for n, x in own.items()]
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def comparable(sql: str, floats: str = "", times: str = "", dates: str = "", ints: str = "") -> str:
    """The query with floats rounded to six places, times and dates as text, and counts as BIGINT."""
    new = [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in floats.split()] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in times.split()]
    new += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    return f"SELECT * REPLACE ({', '.join(new)}) FROM ({sql})" if new else sql
