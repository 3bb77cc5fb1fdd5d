"""Queue sizes recommended from how long a report's runs take."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("mean_seconds", "median_seconds", "p95_seconds", "failure_rate", "log_runs")
#: Training reports that the tasks hold at a time unless told otherwise.
MOST_REPORTS = 100_000
#: Distances that a task holds at once (8 bytes each, twice), and reports whose neighbours it holds.
CELLS, BATCH = 500_000, 1_000


def queue_bands(features: DataFrame, min_runs: int = 20, least_reports: int = 8) -> DataFrame:
    """Reports of at least min_runs with band S, M, L or XL by quartiles of p95_seconds; none under least_reports."""
    kept = features.filter(F.col("runs") >= min_runs)
    cuts = kept.agg(F.percentile("p95_seconds", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"), F.count("*").alias("__n"))
    p = F.col("p95_seconds")
    band = F.when(p <= F.col("__q")[0], "S").when(p <= F.col("__q")[1], "M").when(p <= F.col("__q")[2], "L").otherwise("XL")
    return kept.crossJoin(F.broadcast(cuts)).filter(F.col("__n") >= least_reports).withColumn("band", band).drop("__q", "__n")


def _candidates(told, mean: np.ndarray, std: np.ndarray, k: int):
    """mapInArrow over reports: the k nearest of a block of training reports for each. Besides the block a task
    holds CELLS distances and a batch with its neighbours, all as arrays."""

    def nearest(some: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        far, apart = np.zeros((len(some), len(known))), np.empty((len(some), len(known)))
        for f in range(known.shape[1]):
            np.subtract(some[:, [f]], known[None, :, f], out=apart)
            np.multiply(apart, apart, out=apart)
            far += apart
        for distance, own in zip(far, apart, strict=True):
            own[:] = distance
            own.partition(min(k, len(known)) - 1)
            near = np.flatnonzero(distance <= own[min(k, len(known)) - 1])
            near = near[np.argsort(distance[near], kind="stable")][:k]  # ties to the earlier training report
            yield near, distance[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes, ids, codes, bands = told.value
        step = max(1, CELLS // max(1, len(known)))  # reports whose distances are held at once
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                own = (np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in FEATURES]) - mean) / std
                found = [x for first in range(0, len(own), step) for x in nearest(own[first : first + step], known)]
                near, far = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [pa.array(far), pa.array(hashes[near], pa.int64()), pa.array(ids[near], pa.int64()), pa.array(bands, pa.string()).take(pa.array(codes[near]))]
                ends = np.append(0, np.cumsum([len(x) for x, _ in found])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["far", "hash", "id", "band"]))
                yield pa.RecordBatch.from_arrays([batch.column("__row"), lists], ["__row", "__near"])

    return run


def knn_assign(banded: DataFrame, k: int = 7, hold_out: int = 4, most: int = MOST_REPORTS) -> DataFrame:
    """banded with assigned (majority of the k nearest training reports, ties to the smallest label) and held_out.

    One report in hold_out, by a hash of its id, is not trained on. Features are standardised by the
    training reports. A training report is one of its own neighbours; of equally near ones the first by a hash of the id counts.
    Tasks hold `most` training reports at a time: more are dealt in blocks by that hash, each block gives
    every report its k nearest, and of these the k nearest vote, so all training reports take part.
    """
    df = banded.withColumn("log_runs", F.log1p("runs")).withColumn("held_out", F.pmod(F.xxhash64("report_id"), F.lit(hold_out)) == 0)
    train = df.filter(~F.col("held_out")).select(*FEATURES, "band", F.col("report_id").alias("__id"), F.xxhash64("report_id", F.lit(1)).alias("__hash"))
    scale = train.agg(F.count("*").alias("n"), *(f(F.col(c).cast("double")).alias(f"{i}_{c}") for i, f in enumerate((F.avg, F.stddev_pop)) for c in FEATURES)).first()
    if not scale.n:
        return df.withColumn("assigned", F.lit(None).cast("string"))
    mean, std = (np.array([scale[f"{i}_{c}"] for c in FEATURES], float) for i in (0, 1))
    std = np.where(std > 0, std, 1.0)
    blocks, context = -(-scale.n // most), df.sparkSession.sparkContext
    keyed = df.withColumn("__row", F.struct("report_id", *(F.col(c).cast("double").alias(c) for c in FEATURES)))  # rows alike in these are answered alike
    asked = keyed.select("__row", *(F.col(f"__row.{c}").alias(c) for c in FEATURES)).distinct()
    schema = f"__row {asked.schema['__row'].dataType.simpleString()}, __near array<struct<far: double, hash: bigint, id: bigint, band: string>>"
    found = None
    for number in range(blocks):
        own = train.filter(F.pmod("__hash", F.lit(blocks)) == number).orderBy("__hash", "__id").toPandas()
        if len(own):
            bands, codes = np.unique(own["band"].to_numpy(dtype=str), return_inverse=True)
            told = context.broadcast(((own[list(FEATURES)].to_numpy(dtype=float) - mean) / std, own["__hash"].to_numpy(), own["__id"].to_numpy(), codes, bands.tolist()))
            part = asked.mapInArrow(_candidates(told, mean, std, k), schema)
            found = part if found is None else found.unionByName(part)
    near = F.slice(F.array_sort(F.flatten(F.collect_list("__near"))), 1, k)
    votes = found.groupBy("__row").agg(near.alias("__near")).withColumn("__bands", F.transform("__near", lambda x: x["band"]))
    counts = F.transform(F.array_distinct("__bands"), lambda b: F.struct((-F.size(F.filter("__bands", lambda x: x == b))).alias("n"), b.alias("band")))
    told = votes.select(F.col("__row").alias("__of"), F.array_min(counts)["band"].alias("assigned"))
    return keyed.join(told, F.col("__row").eqNullSafe(F.col("__of"))).select(*df.columns, "assigned")


def knn_accuracy(assigned: DataFrame) -> DataFrame:
    return assigned.filter("held_out").agg(F.count("*").alias("n"), F.avg((F.col("band") == F.col("assigned")).cast("int")).alias("accuracy"))


def queue_profile(banded: DataFrame) -> DataFrame:
    names = ("mean_seconds", "median_seconds", "p95_seconds", "failure_rate")
    return banded.groupBy("band").agg(F.count("*").alias("reports"), *(F.avg(c).alias(c) for c in names))


def queue_table(assigned: DataFrame) -> DataFrame:
    """Current, recommended and assigned queue, by queue and then from the slowest report on."""
    return assigned.select("report_id", "report_name", "queue_id", "band", "assigned", "p95_seconds").orderBy("queue_id", F.desc("p95_seconds"), "report_id")
