"""Ranks, running values and windows over long series, without one task for a whole series.

A series is cut into chunks (hours, or intervals of a number). What a window needs from before a chunk is
scanned over summaries, one row a chunk: hours within their month, then the months of a series as an array.
Windows that reach a fixed number of rows back run over pieces of equal size, each with a halo: the rows before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a piece.
PIECE = 1 << 16
#: Names of the levels, from chunks of rows up.
LEVELS = ("__chunk", "__chunks")


def chunked(df: DataFrame, on: str) -> DataFrame:
    """df with the chunk of each row and that chunk's group: hour and month of a time, or intervals of a number."""
    if isinstance(df.schema[on].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumns({"__chunk": F.date_trunc("hour", on), "__chunks": F.date_trunc("month", on)})
    return df.withColumns({"__chunk": F.floor(F.col(on) / 3600), "__chunks": F.floor(F.col(on) / (720 * 3600))})


def _match(df: DataFrame, side: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """df left-joined to side by keys (null is a key) and levels; side has one row for each of these, and values __before*."""
    names = {c: f"__of{i}" for i, c in enumerate([*keys, *levels])}
    on = [F.col(c).eqNullSafe(F.col(names[c])) if c in keys else F.col(c) == F.col(names[c]) for c in names]
    side = side.select(*(F.col(c).alias(n) for c, n in names.items()), *(c for c in side.columns if c.startswith("__before")))
    return df.join(side, on, "left").drop(*names.values())


def _merged(last: bool, before: Column, own: Column) -> Column:
    return F.coalesce(own, before) if last else F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))


def _total(last: bool, value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order)) if last else F.sum(value)


def _before(rows: DataFrame, keys: Sequence[str], levels: Sequence[str], last: bool, n: int = 1) -> DataFrame:
    """rows, one for each of levels[0], with __before<i>: the sum, or last value, of __total<i> over the rows before it."""
    totals = [f"__total{i}" for i in range(n)]
    if len(levels) == 1:
        lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(levels[0], *totals))).alias("__all"))
        each = lists.select(*keys, "__all", F.posexplode("__all").alias("__i", "__s"))

        def upto(c: str) -> Column:
            kind = rows.schema[c].dataType
            return F.aggregate(F.slice("__all", F.lit(1), F.col("__i")), F.lit(None if last else 0).cast(kind), lambda a, s: _merged(last, a, s[c]).cast(kind))

        return each.select(*keys, F.col(f"__s.{levels[0]}").alias(levels[0]), *(upto(c).alias(f"__before{i}") for i, c in enumerate(totals)))
    window = W.partitionBy(*keys, *levels[1:]).orderBy(levels[0]).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"__near{i}": (F.last(c, ignorenulls=True) if last else F.sum(c)).over(window) for i, c in enumerate(totals)})
    groups = rows.groupBy(*keys, *levels[1:]).agg(*(_total(last, F.col(c), F.col(levels[0])).alias(c) for c in totals))
    out = _match(rows, _before(groups, keys, levels[1:], last, n), keys, levels[1:])
    return out.withColumns({f"__before{i}": _merged(last, F.col(f"__before{i}"), F.col(f"__near{i}")) for i in range(n)}).drop(*totals, *(f"__near{i}" for i in range(n)))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, str], last: bool = False, levels: Sequence[str] = LEVELS, inclusive: bool = True) -> DataFrame:
    """df, which has the levels (see chunked), with new columns (values: new name to column): the sum over the key's rows
    up to each row in ascending order, or with last the last value that isn't null; without inclusive, up to the row before.

    Rows whose chunk is null take only what lies in that chunk.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    window = W.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    own = {f"__near{i}": (F.last(v, ignorenulls=True) if last else F.sum(v)).over(window) for i, v in enumerate(values.values())}
    chunks = df.groupBy(*keys, *levels).agg(*(_total(last, F.col(v), F.struct(*order)).alias(f"__total{i}") for i, v in enumerate(values.values())))
    out = _match(df.withColumns(own), _before(chunks, keys, levels, last, len(values)), keys, levels)
    out = out.withColumns({name: _merged(last, F.col(f"__before{i}"), F.col(f"__near{i}")) for i, name in enumerate(values)})
    return out.drop(*levels, *own, *(f"__before{i}" for i in range(len(values))))


def with_halo(df: DataFrame, keys: Sequence[str], on: str, order: Sequence[str], halo: int, size: int = PIECE) -> DataFrame:
    """df with __piece and __own: pieces of size rows of each key in the order, and copies (not __own) of the halo
    rows before each piece. A window of halo + 1 rows by (keys, __piece) sees all it needs."""
    if not 0 <= halo <= size:
        raise ValueError("the halo is at most a piece")
    own = W.partitionBy(*keys, *LEVELS).orderBy(*order)
    rows = chunked(df, on)
    counts = rows.groupBy(*keys, *LEVELS).agg(F.count("*").alias("__total0"))
    rows = _match(rows.withColumn("__rank", F.row_number().over(own)), _before(counts, keys, LEVELS, False), keys, LEVELS)
    rank = F.col("__rank") + F.coalesce("__before0", F.lit(0))
    piece = F.floor((rank - 1) / size)
    both = F.when(rank > (piece + 1) * size - halo, F.array(piece, piece + 1)).otherwise(F.array(piece))
    out = rows.select(*df.columns, F.posexplode(both).alias("__at", "__piece"))
    return out.withColumn("__own", F.col("__at") == 0).drop("__at")
