"""Drift of a column between the last days (window A) and the days before (window B)."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb, exp, gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drift_windows(df: DataFrame, a: int = 7, b: int = 30) -> DataFrame:
    """Rows of the last a days (side A) and of the b days before them (side B), anchored on the last date."""
    last = df.agg(F.max("date").alias("__last"))
    back = F.datediff("__last", "date")
    tagged = df.crossJoin(F.broadcast(last)).withColumn("side", F.when(back < a, "A").when(back < a + b, "B"))
    return tagged.filter("side is not null").drop("__last")


def _enough(df: DataFrame, least: int) -> DataFrame:
    """df, or no rows if either window has under `least` rows in all."""
    count = df.agg(F.count_if(F.col("side") == "A").alias("__a"), F.count_if(F.col("side") == "B").alias("__b"))
    return df.crossJoin(F.broadcast(count)).filter((F.col("__a") >= least) & (F.col("__b") >= least)).drop("__a", "__b")


def quantile_drift(df: DataFrame, col: str = "duration_seconds", keys: Sequence[str] = ("report_type",), a: int = 7, b: int = 30, least: int = 10) -> DataFrame:
    """Per group that is in both windows: p50, p90 and size of each, and their differences."""
    aggs = []
    for side in "AB":
        own = F.when(F.col("side") == side, F.col(col))
        aggs += [F.percentile(own, 0.5).alias(f"{side}_p50"), F.percentile(own, 0.9).alias(f"{side}_p90"), F.count_if(F.col("side") == side).alias(f"{side}_n")]
    out = _enough(drift_windows(df, a, b), least).groupBy(*keys).agg(*aggs).filter("A_n > 0 and B_n > 0")
    return out.withColumns({"delta_p50": F.col("A_p50") - F.col("B_p50"), "delta_p90": F.col("A_p90") - F.col("B_p90"), "ratio_p90": F.col("A_p90") / (F.col("B_p90") + 1e-9)})


def ks_statistic(df: DataFrame, col: str = "duration_seconds", keys: Sequence[str] = ("report_type",), a: int = 7, b: int = 30, least: int = 5, least_group: int = 3) -> DataFrame:
    """(keys, n_a, n_b, ks): the greatest distance of the two empirical distributions.

    Values are counted by (key, value, side) first, so windows see distinct values, not rows.
    """
    rows = _enough(drift_windows(df, a, b).filter(F.col(col).isNotNull()), least)
    counts = rows.groupBy(*keys, col).agg(F.count_if(F.col("side") == "A").alias("a"), F.count_if(F.col("side") == "B").alias("b"))
    upto = W.partitionBy(*keys).orderBy(col).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    counts = counts.select(*keys, F.sum("a").over(whole).alias("n_a"), F.sum("b").over(whole).alias("n_b"), F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb"))
    counts = counts.filter((F.col("n_a") >= least_group) & (F.col("n_b") >= least_group))
    return counts.groupBy(*keys, "n_a", "n_b").agg(F.max(F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b"))).alias("ks"))


#: Sizes multiplied, up to which the p-value is exact.
EXACT_CELLS = 1_000_000


def _inside(n: int, m: int, limit: int) -> float:
    """The share of the paths from (0, 0) to (n, m), n <= m, on which |i m - j n| stays under limit.

    Paths are counted column by column along the shorter side: those that reach (i, j) are the sum of those that reach (i - 1, 0
    to j). Only where there are more than doubles count, so neither side is short, the shares are followed move by move.
    """
    paths = comb(n + m, n)
    if paths < 10**300:
        count, first = np.ones(1), 0
        for i in range(n + 1):
            low, high = max(0, (i * m - limit) // n + 1), min(m, -((-i * m - limit) // n) - 1)
            if low > high:
                return 0.0
            if i == 0:
                column = np.ones(high - low + 1)
            else:  # of the column before what lies under low leaves the band, and beyond its end nothing is added
                upto = np.append(0.0, np.cumsum(count))
                column = upto[np.minimum(np.arange(low, high + 1) - first + 1, len(count))] - upto[min(low - first, len(count))]
            count, first = column, low
        return float(count[-1] / paths)
    i = np.arange(n + 1)
    share = (i == 0).astype(float)
    for moves in range(1, n + m + 1):
        # The share of paths that are at (i, moves - i) inside the band, by moves in the order of a random draw.
        j = moves - i
        left = n + m - moves + 1
        up = np.append(0.0, share[:-1]) * (n - i + 1) / left
        side = share * np.maximum(m - j + 1, 0) / left
        share = np.where((j >= 0) & (j <= m) & (np.abs(i * m - j * n) < limit), up + side, 0.0)
    return float(share[n])


def ks_pvalue(ks: float, n: int, m: int, exact_cells: int = EXACT_CELLS) -> float:
    """Two-sided p-value of the two-sample statistic.

    Exact where n * m <= exact_cells, by counting the lattice paths that stay within the distance;
    else by the limiting distribution.
    """
    if n * m <= exact_cells:
        step = gcd(n, m)
        limit = int(round(ks * n * m / step)) * step  # |i m - j n| >= limit rejects
        return 1.0 if limit == 0 else float(min(1.0, max(0.0, 1.0 - _inside(min(n, m), max(n, m), limit))))
    x = ks * (n * m / (n + m)) ** 0.5
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * x * x) for k in range(1, 101)))))


def ks_drift(df: DataFrame, col: str = "duration_seconds", keys: Sequence[str] = ("report_type",), alpha: float = 0.05, **windows) -> DataFrame:
    """ks_statistic with p_value, p_exact (whether it is the exact one, see ks_pvalue) and is_drift
    (p_value < alpha); one row per group reaches Python."""

    @F.pandas_udf("double")
    def p(ks: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([ks_pvalue(*x) for x in zip(ks, n.astype(int), m.astype(int), strict=True)])

    out = ks_statistic(df, col, keys, **windows).withColumn("p_value", p("ks", "n_a", "n_b"))
    return out.withColumns({"p_exact": F.col("n_a") * F.col("n_b") <= EXACT_CELLS, "is_drift": F.col("p_value") < alpha})


def psi(df: DataFrame, col: str = "duration_seconds", keys: Sequence[str] = ("report_type",), bins: int = 10, a: int = 7, b: int = 30, floor: float = 1e-6) -> DataFrame:
    """(keys, psi): population stability index of window A against B's quantile bins; shares have a floor."""
    rows = drift_windows(df, a, b).filter(F.col(col).isNotNull()).select(*keys, "side", F.col(col).alias("__x"))
    cuts = [i / bins for i in range(1, bins)]
    edges = rows.filter("side = 'B'").groupBy(*keys).agg(F.percentile("__x", F.array(*map(F.lit, cuts))).alias("__edges"))
    bin_of = F.aggregate("__edges", F.lit(0), lambda n, e: n + F.when(e < F.col("__x"), 1).otherwise(0))
    counts = rows.join(edges, list(keys)).groupBy(*keys, bin_of.alias("bin")).agg(F.count_if(F.col("side") == "A").alias("a"), F.count_if(F.col("side") == "B").alias("e"))
    whole = W.partitionBy(*keys)
    counts = counts.withColumns({"na": F.sum("a").over(whole), "ne": F.sum("e").over(whole)})
    grid = counts.select(*keys, "na", "ne").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts.drop("na", "ne"), [*keys, "bin"], "left")
    share = lambda c, n: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.greatest(F.col(n), F.lit(1)), F.lit(floor))
    x, e = share("a", "na"), share("e", "ne")
    return full.groupBy(*keys).agg(F.sum((x - e) * F.ln(x / e)).alias("psi"))
