"""Ranks: ordinal, averaged, with random tie breaks, and within segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.operators.prefix import ordinal_ranks, rank_splits


def correlation(x: str | Column, y: str | Column, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the pairs without nulls; null where a side doesn't vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    parts = (F.covar_pop(a, b), F.var_pop(a), F.var_pop(b))
    cov, va, vb = (p.over(over) for p in parts) if over is not None else parts
    return F.when((va > 0) & (vb > 0), F.try_divide(cov, F.sqrt(va * vb)))


def pseudo_observations(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], suffix: str = "_u", ranges: int | None = None) -> DataFrame:
    """Ranks over n + 1, ties in time order. With `ranges`, rows of a long series are ranked in ranges of about so many, and counted by an aggregate."""
    out = df
    for c in cols:
        out = ordinal_ranks(out, keys, [c, time], f"{c}_rank", rank_splits(df, c, ranges) if ranges else None)
    if ranges:
        out = out.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys))
    n = F.col("_n") if ranges else F.count("*").over(Window.partitionBy(*keys))
    return out.withColumns({f"{c}{suffix}": F.col(f"{c}_rank") / (n + F.lit(1.0)) for c in cols}).drop("_n")


def average_ranks(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Ranks with ties averaged, over n + 1, centred."""
    order = Window.partitionBy(*keys).orderBy(col)
    ties = F.count("*").over(Window.partitionBy(*keys, col))
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn(name, (F.rank().over(order) + (ties - 1) / F.lit(2.0)) / (n + F.lit(1.0)) - F.lit(0.5))


def jittered_ranks(df: DataFrame, keys: Sequence[str], time: str, col: str, name: str, seed: int) -> DataFrame:
    """Ordinal ranks, ties in the order of a hash of the position and the seed: the law of a random tie break, reproducible."""
    jitter = F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(time).cast("string")).cast("binary"))
    return ordinal_ranks(df.withColumn("_jitter", jitter), keys, [col, "_jitter", time], name).drop("_jitter")


def segment_ranks(df: DataFrame, keys: Sequence[str], time: str, col: str, name: str, at: int) -> DataFrame:
    """Ordinal ranks over m + 1 on either side of a split; m: the side's size."""
    cut = df.withColumn("segment", (F.col(time) > at).cast("int"))
    m = F.count("*").over(Window.partitionBy(*keys, "segment"))
    return ordinal_ranks(cut, [*keys, "segment"], [col, time], "_r").withColumn(name, F.col("_r") / (m + F.lit(1.0))).drop("_r")


def tie_share(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Share of rows whose value occurs more than once."""
    sizes = df.groupBy(*keys, col).agg(F.count("*").alias("_n"))
    return sizes.groupBy(*keys).agg((F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("tie_share"))


def bottom_k(df: DataFrame, keys: Sequence[str], by: Sequence[str], k: int) -> DataFrame:
    """The k rows of each group with the smallest sort keys."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("_k") <= k).drop("_k")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Rank correlation with averaged ties; null below `least` pairs."""
    both = average_ranks(average_ranks(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, "_a"), keys, y, "_b")
    return both.groupBy(*keys).agg(F.when(F.count("*") >= least, correlation("_a", "_b")).alias("spearman"), F.count("*").alias("n"))
