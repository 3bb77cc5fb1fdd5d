"""Column functions shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def success() -> Column:
    return F.col("execution_status") == "success"


def duration() -> Column:
    return F.col("duration_seconds")


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    """0.6745 (x - median) / (mad + 1e-9)."""
    return F.lit(0.6745) * (x - median) / (mad + F.lit(1e-9))


def severity(score: Column) -> Column:
    """mild from 3, moderate from 5, severe from 7; else null."""
    return F.when(score >= 7, "severe").when(score >= 5, "moderate").when(score >= 3, "mild")


def mase_band(mase: Column) -> Column:
    """better below 1, similar up to 1.1, else worse."""
    return F.when(mase < 1, "better").when(mase <= 1.1, "similar").when(mase.isNotNull(), "worse")


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))
