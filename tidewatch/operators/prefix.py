"""Running sums and ranks of long series without putting a series into one task.

A cumulative window over one series is one task, however many executors there are. Here a series is cut into runs of `block`
positions: each run is summed (with partial aggregation), the few sums per series are accumulated, and the running sum inside a
run starts from what lies before it. `block=None` is the plain window, right for many short series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], block: int | None = None) -> DataFrame:
    """Add for each name in `sums` the sum of that expression over positions up to and including the row's (order: 1, 2, ...)."""
    to_here = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if block is None:
        return df.withColumns({n: F.sum(F.expr(e)).over(to_here) for n, e in sums.items()})
    cut = df.withColumn("_run", F.floor((F.col(order) - 1) / block))
    ahead = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    total = cut.groupBy(*keys, "_run").agg(*(F.sum(F.expr(e)).alias(f"_{n}") for n, e in sums.items()))
    total = total.select(*keys, "_run", *(F.sum(f"_{n}").over(ahead).alias(f"_{n}") for n in sums))
    own = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.withColumns({n: F.sum(F.expr(e)).over(own) for n, e in sums.items()}).join(total, [*keys, "_run"])
    zero = {n: F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in sums}
    return out.withColumns(zero).drop("_run", *(f"_{n}" for n in sums))


def rank_splits(df: DataFrame, column: str, block: int) -> list[float]:
    """Values that cut all rows into ranges of about `block` rows (a value that very many rows share stays in one range)."""
    parts = -(-df.count() // block)
    found = df.approxQuantile(column, [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    return sorted({float(v) for v in found})


def ordinal_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, splits: Sequence[float] | None = None) -> DataFrame:
    """Add the ordinal rank 1..n within the keys. With `splits` (ascending values of the first order column) the ranking is
    made within the ranges between them and shifted by the sizes of the lower ranges, so that one series is several tasks."""
    if not splits:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    part = sum((F.when(F.col(order[0]) > F.lit(float(s)), 1).otherwise(0) for s in splits), F.lit(0))
    cut = df.withColumn("_part", part)
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    size = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return cut.withColumn("_own", own).join(F.broadcast(size) if len(splits) <= 64 and not keys else size, [*keys, "_part"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")
