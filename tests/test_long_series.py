"""Ranks, scans, halos and streams over long and hot series against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from joblore.operators import anomalies, evaluate, joins
from joblore.operators.ordered import chunked, running, with_halo
from joblore.streaming import jobs
from tests.test_cleaning_and_series import at, frame

START = at("2024-01-30T22:10:00")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_is_one_task(spark):
    rows = spark.createDataFrame([(1, START, 2.0, 1, 0.5)], "run_id long, t timestamp, x double, hit int, score double")
    runs = rows.select(F.col("t").alias("creation_date"), F.col("t").alias("started_at"))
    grid = rows.select(F.col("t").alias("timestamp_hour"))
    scans = [joins.asof_backward(rows, rows.select("t", F.col("x").alias("v")), "t", ["v"]), joins.backlog_running(runs, grid), evaluate.roc_curve(rows), evaluate.auc(evaluate.roc_curve(rows))]
    for df in scans:
        windows = [x for x in plan(df).splitlines() if "Window [" in x]
        assert windows and not any("], [], [" in x or x.rstrip().endswith("], []") for x in windows)
        assert all("__chunk" in x or "__month" in x for x in windows)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running(spark, keys):
    random.seed(1)
    rows = [(random.choice(["a", "b", None]), START + dt.timedelta(minutes=random.randint(0, 90 * 24 * 60)), i, random.choice([None, 1, 2, -3])) for i in range(500)]
    df = chunked(spark.createDataFrame(rows, "k string, t timestamp, i long, x long"), "t")
    sums = running(df, keys, ["t", "i"], {"s": "x", "n": "i"}).collect()
    last = {r.i: r.v for r in running(df, keys, ["t", "i"], {"v": "x"}, last=True).collect()}
    before = {r.i: r.v for r in running(df, keys, ["t", "i"], {"v": "x"}, last=True, inclusive=False).collect()}
    assert len(sums) == len(rows)
    for r in sums:
        upto = [q for q in sorted(rows, key=lambda q: (q[1], q[2])) if (q[1], q[2]) <= (r.t, r.i) and (not keys or q[0] == r.k)]
        assert (r.s, r.n) == (sum(q[3] or 0 for q in upto), sum(q[2] for q in upto))
        assert last[r.i] == next((q[3] for q in reversed(upto) if q[3] is not None), None)
        assert before[r.i] == next((q[3] for q in reversed(upto[:-1]) if q[3] is not None), None)


def test_asof_backward_without_keys(spark):
    random.seed(2)
    left = [(i, START + dt.timedelta(minutes=random.randint(0, 80_000))) for i in range(200)] + [(900, None), (901, START - dt.timedelta(days=400))]
    right = [(START + dt.timedelta(minutes=random.randint(0, 80_000)), i) for i in range(60)] + [(START, 77), (START, 78), (None, 5)]
    got = joins.asof_backward(spark.createDataFrame(left, "i long, t timestamp"), spark.createDataFrame(right, "t timestamp, v long"), "t", ["v"], tie="v").collect()
    expected = {i: None if t is None else max(((s, str(v), v) for s, v in right if s is not None and s <= t), default=(0, 0, None))[2] for i, t in left}
    assert {r.i: r.v for r in got} == expected and len(got) == len(left)


def test_roc_and_auc(spark):
    random.seed(3)
    rows = [(random.choice("ab"), round(random.random(), 3), random.randint(0, 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "model string, score double, hit int")
    for keys in ([], ["model"]):
        roc = evaluate.roc_curve(df, keys=keys)
        areas = {(r.model if keys else None): r.auc for r in evaluate.auc(roc, keys=keys).collect()}
        for r in roc.collect():
            own = [x for x in rows if not keys or x[0] == r.model]
            assert r.tpr == pytest.approx(sum(h for _, s, h in own if s >= r.score) / sum(h for *_, h in own))
            assert r.fpr == pytest.approx(sum(1 - h for _, s, h in own if s >= r.score) / sum(1 - h for *_, h in own))
        for model, area in areas.items():
            yes, no = ([s for m, s, h in rows if h == want and model in (None, m)] for want in (1, 0))
            assert area == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / len(yes) / len(no))


def test_a_hot_report_is_dealt_in_pieces(spark, monkeypatch):
    """A third of all rows are one report's: no piece holds more than its size and the rows before it."""
    random.seed(4)
    rows = [(i, "hot" if i % 3 == 0 else f"r{i % 50}", "success", random.randint(1, 400) if i % 97 else 9000, START + dt.timedelta(seconds=random.randint(0, 400_000))) for i in range(3000)]
    df = frame(spark, rows)
    pieces = with_halo(df, ["report_name"], "started_at", ["started_at", "run_id"], 49, 100)
    assert pieces.filter("__own").count() == len(rows)
    assert pieces.groupBy("report_name", "__piece").count().agg(F.max("count")).first()[0] <= 149
    whole = {r.run_id: r.score for r in anomalies.anomalies_adaptive(df).collect()}
    monkeypatch.setattr(anomalies, "PIECE", 100)
    assert whole == {r.run_id: r.score for r in anomalies.anomalies_adaptive(df).collect()} and len(whole) > 5


def test_streamed_state_goes_with_time(spark, tmp_path):
    """200 hours of runs: the state keeps the last hours only, pairs are those of the batch, and late runs are dropped."""
    rows = [(i, f"r{i % 3}", "success", 1, START + dt.timedelta(seconds=45 * i)) for i in range(16_000)]
    df = frame(spark, rows)
    for n in range(8):  # files of 25 hours, in order of time
        df.filter(F.col("run_id").between(2000 * n, 2000 * n + 1999)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late = frame(spark, [(99_999, "r0", "success", 1, START + dt.timedelta(seconds=46))])
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = jobs.stream_double_runs(stream, 140).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        out.start().awaitTermination()
        return sorted((r.run_id, r.previous_run, r.gap_seconds) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    try:
        expected = sorted((r.run_id, r.previous_run, r.gap_seconds) for r in anomalies.double_runs(df, 140).collect())
        assert run() == expected and len(expected) == 16_000 - 3
        held = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "last").load().count()
        assert 0 < held <= 3 * 28  # a batch's 25 hours and the watermark's 2, of 200
        late.write.mode("append").parquet(f"{tmp_path}/in")
        assert run() == expected
    finally:
        spark.conf.set(key, before)
