"""Incremental jobs: hourly counts and double runs of a stream of executions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from joblore.operators.anomalies import stretch_micros, stretches


def stream_hourly_counts(stream: DataFrame, watermark: str = "2 hours", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, timestamp_hour, report_count); rows later than the watermark are dropped."""
    counts = stream.withWatermark("started_at", watermark).groupBy(*keys, F.window("started_at", "1 hour")).agg(F.count("*").alias("report_count"))
    return counts.select(*keys, F.col("window.start").alias("timestamp_hour"), "report_count")


class LastStart(StatefulProcessor):
    """Keeps the last start of each report and stretch of time and emits runs that follow it within a threshold.

    When the watermark has passed a stretch's end no more of its runs can come, and a timer clears its state.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "run_id long, micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["micros", "run_id"])
        before, out = self.last.get(), []  # each call of the state is a round trip to the store
        if before is None:
            self.handle.registerTimer((int(key[1]) + 1) * stretch_micros(self.threshold) // 1000)
        for run_id, micros, own in zip(frame["run_id"], frame["micros"], frame["own"], strict=True):
            if before is not None and own:
                gap = (int(micros) - before[1]) // 1_000_000
                if 0 <= gap <= self.threshold:
                    out.append((key[0], int(run_id), int(before[0]), int(gap)))
            if before is None or (micros, run_id) > (before[1], before[0]):
                before = (int(run_id), int(micros))
        self.last.update(before)
        if out:
            yield pd.DataFrame(out, columns=["report_name", "run_id", "previous_run", "gap_seconds"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_double_runs(stream: DataFrame, threshold: float = 60, watermark: str = "2 hours") -> DataFrame:
    """(report_name, run_id, previous_run, gap_seconds): successful runs within threshold seconds of their report's last.

    Within a batch runs are taken in order of their start; one that comes in a later batch than its
    successor is compared with the last start seen. State is kept by report and stretch of time, so a
    report with very many runs is many keys; the runs at the end of a stretch are known to the next too.
    Runs that come when the watermark has passed their start are dropped, as in stream_hourly_counts, and are nobody's
    predecessor; what is kept of a stretch goes when the watermark has passed its end, so the state holds the
    stretches of the last hours only.
    """
    stream = stream.withWatermark("started_at", watermark).filter("execution_status = 'success'")
    rows = stream.select("report_name", "run_id", "started_at", F.unix_micros("started_at").alias("micros"), F.posexplode(stretches(F.col("started_at"), threshold)).alias("at", "stretch"))
    rows = rows.select("report_name", "stretch", "run_id", "started_at", "micros", (F.col("at") == 0).alias("own"))
    return rows.groupBy("report_name", "stretch").transformWithStateInPandas(
        LastStart(threshold), outputStructType="report_name string, run_id long, previous_run long, gap_seconds long", outputMode="Append", timeMode="EventTime"
    )
