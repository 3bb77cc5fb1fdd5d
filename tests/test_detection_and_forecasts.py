"""Anomalies, drift, evaluation, forecasts, queues and streams on frames worked out by hand."""

import datetime as dt
import itertools
import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joblore.operators import anomalies, drift, evaluate, forecast, joins, queues, series
from joblore.plans import catalog
from joblore.streaming import jobs
from tests.test_cleaning_and_series import at, frame


def test_anomalies(spark):
    rows = [(i, "a", "success", 30 + (i % 2) * 10, at("2024-01-01T05:00:00") + dt.timedelta(minutes=i)) for i in range(20)]
    rows += [(100, "a", "success", 900, at("2024-01-01T06:00:00")), (101, "a", "failed", 900, at("2024-01-01T06:01:00")), (102, "flat", "success", 5, at("2024-01-01")), (103, "flat", "success", 5, at("2024-01-01"))]
    df = frame(spark, rows)
    for job in (anomalies.anomalies_global, anomalies.anomalies_adaptive, anomalies.anomalies_contextual_adaptive):
        assert [r.run_id for r in job(df).collect()] == [100]  # only successes, and no report without spread
    assert anomalies.anomalies_adaptive(df, min_periods=50).count() == 0
    thresholds = {(r.report_name, r.hour): r.mad for r in anomalies.context_thresholds(df).collect()}
    assert thresholds[("flat", 0)] == pytest.approx((5 + 0 + 0) / 3)  # the mean of all, in place of 0
    assert {r.run_id for r in anomalies.threshold_exceptions(df, anomalies.context_thresholds(df.filter("run_id < 100")), 3.5).collect()} == set()
    scores = {r.run_id: r.score for r in anomalies.isolation_scores(df).collect()}
    assert len(scores) == len(rows) and min(scores[100], scores[101]) > max(scores[i] for i in range(20))
    assert anomalies.isolation_scores(df.limit(0)).count() == 0


def test_double_runs(spark):
    t = at("2024-01-01")
    gaps = [(1, "a", 0), (2, "a", 60), (3, "a", 60), (4, "a", 121), (5, "b", 122), (6, "b", 182.9)]
    df = frame(spark, [(i, n, "success", 1, t + dt.timedelta(seconds=s)) for i, n, s in gaps] + [(7, "b", "cancelled", 1, t + dt.timedelta(seconds=130))])
    pairs = anomalies.double_runs(df, 60)
    assert sorted((r.run_id, r.previous_run, r.gap_seconds) for r in pairs.collect()) == [(2, 1, 60), (3, 2, 0), (6, 5, 60)]
    assert anomalies.double_runs(df, 60, include_cancelled=True).count() == 4
    assert anomalies.double_runs(df, 60, match_params=True).count() == 3  # null parameters are equal
    assert anomalies.double_run_summary(pairs).first().reports == 2


def drift_by_moves(n, m, limit):
    """The share of random orders of n and m whose running shares stay within the distance, move by move."""
    share = {0: 1.0}
    for moves in range(1, n + m + 1):
        new: dict = {}
        for i, p in share.items():
            j, left = moves - 1 - i, n + m - moves + 1
            for to, q in ((i + 1, (n - i) / left), (i, (m - j) / left)):
                if q > 0 and abs(to * m - (moves - to) * n) < limit:
                    new[to] = new.get(to, 0.0) + p * q
        share = new
    return share.get(n, 0.0)


def test_ks(spark):
    assert drift.ks_pvalue(1.0, 3, 3) == pytest.approx(0.1) and drift.ks_pvalue(0.0, 3, 4) == 1.0
    n, m = 4, 5  # against all interleavings
    every = []
    for a in itertools.combinations(range(n + m), n):
        i = np.cumsum([k in a for k in range(n + m)])
        j = np.arange(1, n + m + 1) - i
        every.append(max(abs(i / n - j / m)))
    for d in sorted(set(np.round(every, 9))):
        assert drift.ks_pvalue(d, n, m) == pytest.approx(np.mean(np.array(every) >= d - 1e-9))
    assert drift.ks_pvalue(0.3, 3, 330_000) == pytest.approx(1 - 6 * (2 * 0.3 - 1 / 3) ** 3, abs=1e-4) and drift.ks_pvalue(0.9, 330_000, 3) == pytest.approx(drift.ks_pvalue(0.9, 3, 330_000))
    for a, b, d in ((7, 300, 0.2), (40, 41, 0.31), (150, 6000, 0.08), (500, 600, 0.05)):  # both ways of counting
        step = math.gcd(a, b)
        limit = round(d * a * b / step) * step
        assert drift.ks_pvalue(d, a, b) == pytest.approx(1 - drift_by_moves(a, b, limit), abs=1e-9)
    assert drift.ks_pvalue(0.05, 2000, 2000) == pytest.approx(0.0135, abs=2e-3)
    days = [at("2024-01-30") - dt.timedelta(days=d) for d in range(30)]
    df = frame(spark, [(i, "x", "success", (100 if i % 30 < 7 else 10) + i % 5, days[i % 30]) for i in range(120)])
    row = drift.ks_drift(df, keys=["report_name"]).first()
    assert row.ks == 1.0 and row.is_drift and (row.n_a, row.n_b) == (28, 92)
    q = drift.quantile_drift(df, keys=["report_name"]).first()
    assert q.delta_p90 == 90 and q.A_n == 28
    assert drift.quantile_drift(df.filter("date < '2024-01-24' or run_id < 5"), keys=["report_name"]).count() == 0  # under ten in A
    assert drift.psi(df, keys=["report_name"]).first().psi > 1


def test_forecast_evaluation(spark):
    h = at("2024-01-01")
    rows = spark.createDataFrame([(h + dt.timedelta(hours=i), float(i % 24)) for i in range(24 * 20)], "timestamp_hour timestamp, report_count double")
    assert {r.mae for r in evaluate.rolling_origin(rows).collect()} == {0.0}
    folds = evaluate.walk_forward_folds(rows).groupBy("fold", "part").count().collect()
    assert {(r.fold, r["count"]) for r in folds if r.part == "test"} == {(i, 80) for i in range(1, 6)} and {(r.fold, r["count"]) for r in folds if r.part == "train"} == {(i, 80 * i) for i in range(1, 6)}
    assert evaluate.acf(rows, "report_count").filter("lag = 24").first().acf == pytest.approx(1)
    assert evaluate.acf(rows.withColumn("report_count", F.lit(1.0)), "report_count").count() == 0
    assert evaluate.error_metrics(rows.withColumn("p", F.lit(None).cast("double")), "report_count", "p").first().mae is None
    assert evaluate.mase(rows.limit(1), rows.withColumn("p", F.lit(0)), "report_count", "p").first().mase is None
    fc = rows.limit(23).select(F.col("timestamp_hour").alias("ds"), F.lit(1.0).alias("y_p10"), F.lit(2.0).alias("y_pred"), F.lit(3.0).alias("y_p90"))
    actual = rows.select(F.col("timestamp_hour").alias("ds"), F.col("report_count").alias("y_actual"))
    assert evaluate.horizon_eval(fc, actual).count() == 0


def test_roc_is_perfect_for_one_ordering(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in r.uniform(0, 100, (200, 3))], "y double, p double, q double")
    hits = evaluate.hit_labels(df, "y", ["p", "q"])
    assert {round(x.auc, 9) for x in evaluate.auc(evaluate.roc_curve(hits, keys=["model"]), keys=["model"]).collect()} == {1.0}
    assert evaluate.confusion(hits).agg(F.sum("n")).first()[0] == 400 and evaluate.confusion(hits.limit(0)).count() == 4


def test_forecasts(spark):
    h = at("2024-01-01")
    rows = spark.createDataFrame([(k, h + dt.timedelta(hours=i), 10 + i % 24) for k in "ab" for i in range(24 * 21)], "k string, timestamp_hour timestamp, report_count long")
    got = forecast.recursive_forecast(rows, 30, ["k"]).orderBy("k", "step").collect()
    assert len(got) == 60 and all(r.y_pred >= 0 for r in got)
    assert np.mean([abs(r.y_pred - (10 + r.step % 24)) for r in got if r.k == "a"]) < 3
    assert forecast.hourly_bias(spark.createDataFrame([], "hour int, y double, y_pred double")).agg(F.count("*"), F.sum("value")).first()[:] == (24, 0.0)
    assert forecast.seasonal_table(rows.filter("k = 'a'")).count() == 168
    fc = spark.createDataFrame([(at("2024-01-16T09:00:00"), 5.0, 4.0, 9.0), (at("2024-01-17T09:00:00"), 5.0, 6.0, 9.0)], "ds timestamp, y_p10 double, y_pred double, y_p90 double")
    hol = spark.sql("SELECT DATE'2024-01-15' AS date")
    assert [round(r.y_pred, 6) for r in forecast.return_to_work(fc, hol).orderBy("ds").collect()] == [4.4, 6.0]
    assert forecast.return_to_work(fc, hol).filter("y_p10 <= y_pred and y_pred <= y_p90").count() == 2


def test_queues(spark):
    cols = "report_id long, report_name string, queue_id int, runs long, mean_seconds double, median_seconds double, p95_seconds double, failure_rate double"
    rows = [(i, f"r{i}", 1, 20 if i else 19, float(i), float(i), float(i), 0.0) for i in range(41)]
    df = spark.createDataFrame(rows, cols)
    banded = queues.queue_bands(df)
    assert banded.count() == 40 and {r.band for r in banded.collect()} == {"S", "M", "L", "XL"}
    assert queues.queue_bands(df.filter("report_id <= 7")).count() == 0
    out = queues.knn_assign(banded, 3)
    assert queues.knn_accuracy(out).first().accuracy > 0.6
    assert queues.knn_assign(banded.limit(0)).count() == 0


def test_knn_queries_run_the_assignment(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["knn_assign"](spark, sf).collect()
    table = {r.report_id: (r.band, r.assigned) for r in catalog.QUERIES["knn_queue_table"](spark, sf).collect()}
    assert table == {r.report_id: (r.band, r.assigned) for r in rows}
    held = [r for r in rows if r.held_out]
    got = catalog.QUERIES["knn_accuracy"](spark, sf).first()
    assert got.n == len(held) and (not held or abs(got.accuracy - sum(r.band == r.assigned for r in held) / len(held)) < 1e-12)
    own = catalog.banded(spark, sf)
    blocks = {r.report_id: r.assigned for r in queues.knn_assign(own, 7, most=5).collect()}  # all training reports vote, whatever a task holds
    assert blocks == {r.report_id: r.assigned for r in rows}


def test_streams_agree_with_batch(spark, tmp_path):
    t = at("2024-01-01")
    df = frame(spark, [(i, f"r{i % 2}", "success", 1, t + dt.timedelta(seconds=40 * i)) for i in range(400)])
    df.repartitionByRange(4, "started_at").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(job, name):
        query = job(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        query.awaitTermination()
        return spark.table(name).collect()

    batch = {(r.timestamp_hour, r.report_count) for r in series.hourly_counts(df).collect()}
    assert {(r.timestamp_hour, r.report_count) for r in run(jobs.stream_hourly_counts, "hours")} <= batch
    pairs = {(r.run_id, r.previous_run) for r in anomalies.double_runs(df, 90).collect()}
    assert {(r.run_id, r.previous_run) for r in run(lambda s: jobs.stream_double_runs(s, 90), "doubles")} == pairs and len(pairs) == 398


def test_double_runs_across_stretches(spark):
    """Runs every 50 seconds for six hours, so pairs lie across the stretches of time that a report is dealt by."""
    t = at("2024-01-01T00:00:07")
    df = frame(spark, [(i, "a", "success", 1, t + dt.timedelta(seconds=50 * i)) for i in range(432)] + [(9999, "a", "success", 1, t + dt.timedelta(seconds=50 * 431 + 61))])
    got = anomalies.double_runs(df, 60)
    assert sorted((r.run_id, r.previous_run, r.gap_seconds) for r in got.collect()) == [(i, i - 1, 50) for i in range(1, 432)]
    assert "__stretch" not in got.columns


def test_changes_are_the_last_before_each_run(spark):
    commits = [("a.sql", at("2024-01-01") + dt.timedelta(hours=h // 2), f"{h:03d}", "x", "m") for h in range(200)]
    runs_ = [(i, at("2024-01-01") + dt.timedelta(hours=i), "a") for i in range(0, 100, 7)]
    got = joins.changes_before(
        spark.createDataFrame(runs_, "run_id long, started_at timestamp, action_path string"), spark.createDataFrame(commits, "path string, commit_ts timestamp, hash string, author string, message string"), 5
    ).collect()
    expected = set()
    for i, start, _ in runs_:
        own = sorted((c for c in commits if c[1] <= start), key=lambda c: (-c[1].timestamp(), c[2]))[:5]
        expected |= {(i, k + 1, c[2]) for k, c in enumerate(own)}
    assert {(r.run_id, r["rank"], r.hash) for r in got} == expected and len(got) == len(expected)


def plain_knn(train, rows, k):
    x = np.array([r[0] for r in train])
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 0, std, 1)
    out = []
    for row in rows:
        own = (np.array(row) - mean) / std
        far = [sum((own[f] - known[f]) ** 2 for f in range(len(own))) for known in (x - mean) / std]
        votes = [train[i][1] for i in sorted(range(len(train)), key=lambda i: (far[i], i))[:k]]
        out.append(min(set(votes), key=lambda b: (-votes.count(b), b)))
    return out


def test_knn_against_plain_votes(spark, monkeypatch):
    monkeypatch.setattr(queues, "CELLS", 100)  # several blocks of distances
    r = np.random.default_rng(5)
    rows = [(i, f"r{i}", *map(float, r.uniform(0, 5, 3)), float(r.random() < 0.5), int(r.integers(20, 90)), "SML"[int(r.integers(3))], 1) for i in range(120)]
    banded = spark.createDataFrame(rows, "report_id long, report_name string, mean_seconds double, median_seconds double, p95_seconds double, failure_rate double, runs long, band string, queue_id long")
    got = {x.report_id: x for x in queues.knn_assign(banded, 5).collect()}
    order = banded.select("report_id", F.xxhash64("report_id", F.lit(1)).alias("h")).orderBy("h", "report_id").collect()
    vector = lambda x: [x.mean_seconds, x.median_seconds, x.p95_seconds, x.failure_rate, np.log1p(x.runs)]
    train = [(vector(got[o.report_id]), got[o.report_id].band) for o in order if not got[o.report_id].held_out]
    assert [x.assigned for x in got.values()] == plain_knn(train, [vector(x) for x in got.values()], 5)
    for most in (len(train) // 3 + 1, 7):  # three blocks, and many
        assert {x.report_id: x.assigned for x in queues.knn_assign(banded, 5, most=most).collect()} == {i: x.assigned for i, x in got.items()}
    twice = queues.knn_assign(banded.unionByName(banded.limit(10)), 5)
    assert twice.count() == 130 and twice.groupBy("report_id").agg(F.count_distinct("assigned").alias("n")).filter("n > 1").count() == 0


def test_evaluation_by_series(spark):
    """Each of two series gives what it gives alone."""
    h, r = at("2024-01-01"), np.random.default_rng(6)
    rows = [(k, h + dt.timedelta(hours=i), float(r.integers(0, 80)), float(r.integers(0, 80)), "train" if i < 400 else "test") for k in "ab" for i in range(500)]
    df = spark.createDataFrame(rows, "k string, timestamp_hour timestamp, report_count double, p double, split string")
    jobs_ = [
        lambda d, keys: evaluate.mase(d.filter("split = 'train'"), d.filter("split = 'test'"), "report_count", "p", keys=keys),
        lambda d, keys: evaluate.holdout_report(d, pred="p", keys=keys),
        lambda d, keys: evaluate.acf(d, "report_count", max_lag=3, keys=keys),
        lambda d, keys: evaluate.walk_forward_eval(d, pred="p", keys=keys),
        lambda d, keys: evaluate.walk_forward_folds(d, keys=keys).groupBy(*keys, "fold", "part").count(),
        lambda d, keys: evaluate.rolling_origin(d, keys=keys),
    ]
    flat = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in rows), key=str)
    for job in jobs_:
        both = job(df, ["k"])
        for k in "ab":
            assert flat(both.filter(F.col("k") == k).drop("k").collect()) == flat(job(df.filter(F.col("k") == k).drop("k"), []).collect())


def test_horizon_figures(spark):
    """30 hours worked out by hand: errors of 2, 4 and 30; 10 of 30 outside the band."""
    h = at("2024-01-01")
    rows = [(h + dt.timedelta(hours=i), *((18.0, 20.0, 25.0, 22) if i % 3 == 0 else (20.0, 24.0, 26.0, 20) if i % 3 == 1 else (40.0, 50.0, 60.0, 80))) for i in range(30)]
    df = spark.createDataFrame(rows, "ds timestamp, y_p10 double, y_pred double, y_p90 double, y_actual long")
    got = evaluate.horizon_eval(df.drop("y_actual"), df.select("ds", "y_actual")).first()
    assert (got.n, got.mae, got.bias, got.high_volume_bias) == (30, pytest.approx(12), pytest.approx((-2 + 4 - 30) / 3), pytest.approx(-30))
    assert got.rmse == pytest.approx(((4 + 16 + 900) / 3) ** 0.5) and got.coverage_pct == pytest.approx(200 / 3)
    res = evaluate.residuals(df, "y_actual", "y_pred").groupBy("y_pred").agg(F.min("residual").alias("a"), F.max("residual").alias("b")).collect()
    assert {(r.y_pred, r.a, r.b) for r in res} == {(20.0, 2.0, 2.0), (24.0, -4.0, -4.0), (50.0, 30.0, 30.0)}


def test_recursive_forecast_adjusts_each_step(spark):
    """Each step's bands are those that adjust_forecast makes of its raw prediction, and are fed back."""
    h, r = at("2024-01-01"), np.random.default_rng(3)
    rows = [(k, h + dt.timedelta(hours=i), float(20 + 30 * (9 <= i % 24 <= 16) + r.integers(0, 9)) * (2 if k == "b" else 1), float(i % 7), float(r.integers(10, 60))) for k in "ab" for i in range(24 * 30)]
    df = spark.createDataFrame(rows, "k string, timestamp_hour timestamp, report_count double, backlog double, y_pred double")
    maps = forecast.series_maps(df, df.filter(F.col("timestamp_hour") >= F.lit(h + dt.timedelta(days=20))), ["k"])
    got = forecast.recursive_forecast(df, 60, ["k"], maps=maps, extra=["backlog"]).cache()
    assert got.count() == 120 and got.filter("p_spike >= 0.5").count() > 0
    for own in maps.collect():
        of = lambda name, size, own=own: spark.createDataFrame([(i, own[name].get(i)) for i in range(size)], f"at int, {name} double")
        hours = {c: of(c, 24).withColumnRenamed("at", "hour") for c in ("bias", "floor", "low", "high", "spike")}
        cells = of("seasonal", 168).select((F.col("at") / 24).cast("int").alias("weekday"), (F.col("at") % 24).alias("hour"), "seasonal")
        raw = got.filter(F.col("k") == own.k).select("ds", "step", F.hour("ds").alias("hour"), F.weekday("ds").alias("weekday"), F.col("y_raw").alias("y_p50"), "p_spike")
        raw = raw.join(hours["low"], "hour").join(hours["high"], "hour").withColumns({"y_p10": F.greatest(F.lit(0.0), F.col("y_p50") + F.col("low")), "y_p90": F.greatest(F.lit(0.0), F.col("y_p50") + F.col("high"))})
        spikes = hours["spike"].filter("spike is not null").select("hour", F.col("spike").alias("spike_mean"), F.lit(own.overall).alias("overall_mean"))
        expected = forecast.adjust_forecast(raw, *(hours[c].select("hour", F.col(c).alias("value")) for c in ("bias", "floor")), spikes, cells)
        both = expected.join(got.filter(F.col("k") == own.k).select("step", *(F.col(c).alias(f"own_{c}") for c in ("y_p10", "y_pred", "y_p90"))), "step").collect()
        assert len(both) == 60 and all(abs(x[c] - x[f"own_{c}"]) < 0.006 for x in both for c in ("y_p10", "y_pred", "y_p90"))
    bare = forecast.recursive_forecast(df, 60, ["k"], extra=["backlog"])
    values = [{(r.k, r.step): r.y_pred for r in df.select("k", "step", "y_pred").collect()} for df in (bare, got)]
    assert sum(values[0][x] != values[1][x] for x in values[1]) > 60
    assert forecast.recursive_forecast(df.filter("k = 'a'").drop("k"), 5, extra=["backlog"]).filter("y_pred = y_raw").count() == 5


FEATURES = ("hour", "weekday", "y_lag_1", "y_lag_24")


def busy_hours(spark, days=40):
    """20 runs an hour and 50 in working hours, give or take a few; the last 10 days are for testing."""
    h, rows, y, r = at("2024-01-01"), [], [], np.random.default_rng(1)
    for i in range(24 * days):
        hour, weekday = i % 24, i // 24 % 7
        y.append(20.0 + 30.0 * (9 <= hour <= 16 and weekday < 5) + float(r.integers(-5, 6)))
        rows.append((h + dt.timedelta(hours=i), hour, weekday, y[i - 1] if i else 0.0, y[i - 24] if i >= 24 else 0.0, y[i]))
    df = spark.createDataFrame(rows, "ds timestamp, hour int, weekday int, y_lag_1 double, y_lag_24 double, report_count double")
    cut = F.lit(h + dt.timedelta(days=days - 10))
    return df.filter(F.col("ds") < cut), df.filter(F.col("ds") >= cut)


def test_point_model_beats_the_naive_forecast(spark):
    train, test = busy_hours(spark)
    model = forecast.fit_point_model(train, FEATURES, trees=10)
    scored = forecast.score_point_model(model, test, FEATURES)
    own, naive = (scored.agg(F.avg(F.abs(F.col("report_count") - F.col(c)))).first()[0] for c in ("y_pred", "y_lag_1"))
    assert own < 0.8 * naive and scored.filter("y_pred < 0").count() == 0
    noon, night = (forecast.scenario(model, test, {"hour": h, "weekday": 1, "y_lag_1": y, "y_lag_24": y}, FEATURES).agg(F.avg("y_pred")).first()[0] for h, y in ((12, 50), (3, 20)))
    assert noon > night + 20
    assert forecast.scenario(model, test.drop("y_lag_24"), {}, FEATURES).count() == test.count()  # an absent feature counts 0


def test_spike_probability_tells_spikes(spark):
    train, test = busy_hours(spark)
    got = forecast.spike_probability(train, test, FEATURES, trees=5)
    p = {r.spike: r.p for r in got.groupBy((F.col("report_count") > 40).alias("spike")).agg(F.avg("p_spike").alias("p")).collect()}
    assert p[True] > 0.8 > 0.2 > p[False] and got.filter("p_spike < 0 or p_spike > 1").count() == 0
    lag = got.filter("hour = 12 and weekday < 5").agg(F.avg("p_spike")).first()[0]
    low = forecast.spike_probability(train, test.withColumns({"y_lag_1": F.lit(15.0), "y_lag_24": F.lit(15.0), "hour": F.lit(3)}), FEATURES, trees=5).agg(F.avg("p_spike")).first()[0]
    assert lag > low


def test_fits_read_their_rows_from_one_table(spark):
    for part in catalog._halves(spark, "/root/testdata/sf0.001"):
        assert part.count() > 0 and all("/split-" in file for file in part.inputFiles())  # not the runs, again for each pass of a fit


def test_knn_tasks_hold_little(spark):
    r = np.random.default_rng(6)
    x, asked = r.normal(size=(20_000, 5)), r.normal(size=(1500, 5))
    told = SimpleNamespace(value=(x, np.arange(20_000), np.arange(20_000), np.arange(20_000) % 2, ["L", "S"]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(asked))), *map(pa.array, asked.T)], ["__row", *queues.FEATURES])
    tracemalloc.start()
    out = pa.Table.from_batches(queues._candidates(told, np.zeros(5), np.ones(5), 7)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20 and out.column("__row").to_pylist() == list(range(1500))  # 4,000,000 distances at a time took over 100 MB
    for row, near in list(zip(asked, out.column("__near").to_pylist(), strict=True))[::250]:
        assert [n["id"] for n in near] == np.argsort(((x - row) ** 2).sum(axis=1), kind="stable")[:7].tolist() and all(n["band"] == "LS"[n["id"] % 2] for n in near)
