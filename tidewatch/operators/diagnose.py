"""Exchangeability diagnostics: autocorrelations, portmanteau statistics, profiles of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranks import correlation


def effective_sample_size(df: DataFrame, keys: Sequence[str], t: str, col: str) -> DataFrame:
    """First autocorrelation of the rows without nulls, and n (1 - r) / (1 + r)."""
    kept = df.filter(F.col(col).isNotNull())
    pairs = kept.withColumn("_b", F.lag(col).over(Window.partitionBy(*keys).orderBy(t)))
    out = pairs.groupBy(*keys).agg(F.count("*").alias("_n"), correlation(col, "_b").alias("r1"))
    return out.withColumn("ess", F.try_divide(F.col("_n") * (1 - F.col("r1")), 1 + F.col("r1"))).drop("_n")


def acf(df: DataFrame, keys: Sequence[str], t: str, col: str, lags: int, other: str | None = None) -> DataFrame:
    """(keys, n, lag, r): sums of products at each lag over the root of the sums of squares; `other`: cross-correlations of col at t with
    other at t + lag. Each row meets `lags` rows through an equality join on shifted positions."""
    every = Window.partitionBy(*keys)
    z = df.select(*keys, F.col(t).alias("_t"), (F.col(col) - F.avg(col).over(every)).alias("_a"), (F.col(other or col) - F.avg(other or col).over(every)).alias("_b"), F.count("*").over(every).alias("n"))
    scale = z.groupBy(*keys).agg(F.sqrt(F.sum(F.expr("_a * _a")) * F.sum(F.expr("_b * _b"))).alias("_s"))
    ahead = z.select(*keys, "n", "_a", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "_t").withColumn("_t", F.col("_t") + F.col("lag"))
    sums = ahead.join(z.select(*keys, "_t", "_b"), [*keys, "_t"]).groupBy(*keys, "n", "lag").agg(F.sum(F.expr("_a * _b")).alias("_p"))
    return sums.join(scale, list(keys)).select(*keys, "n", "lag", F.try_divide("_p", "_s").alias("r"))


def ljung_box(correlations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n (n + 2) times the sum of r^2 / (n - lag)."""
    return correlations.groupBy(*keys, "n").agg(F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag"))).alias("_s")).select(*keys, (F.col("n") * (F.col("n") + 2.0) * F.col("_s")).alias("q"))


def cross_portmanteau(df: DataFrame, keys: Sequence[str], t: str, x: str, y: str, lags: int) -> DataFrame:
    """The same sum over cross-correlations in both directions."""
    both = acf(df, keys, t, x, lags, y).unionAll(acf(df, keys, t, y, lags, x))
    return ljung_box(both, keys)


def tau_int(correlations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 + 2 times the sum of the correlations before the first that isn't positive."""
    to = Window.partitionBy(*keys).orderBy("lag")
    live = correlations.withColumn("_low", F.min("r").over(to)).withColumn("_r", F.when(F.col("_low") > 0, F.col("r")).otherwise(0.0))
    return live.groupBy(*keys).agg((1 + 2 * F.sum("_r")).alias("tau"))


def block_profile(df: DataFrame, keys: Sequence[str], t: str, col: str, size: int) -> DataFrame:
    """Mean and population variance of each full block with at least half its values present (positions from 1)."""
    n = F.max(t).over(Window.partitionBy(*keys))
    cut = df.withColumn("_n", n).withColumn("block", F.floor((F.col(t) - 1) / size).cast("long")).filter((F.col("block") + 1) * size <= F.col("_n"))
    return cut.groupBy(*keys, "block").agg(F.count(col).alias("cnt"), F.avg(col).alias("mean"), F.var_pop(col).alias("var")).filter(F.col("cnt") >= size // 2)


def annual_harmonic(df: DataFrame, keys: Sequence[str], frac: str, value: str) -> DataFrame:
    """Amplitude of the least-squares wave of one year: the normal equations' 3x3 system in closed form."""
    c, s = F.cos(2 * F.pi() * F.col(frac)), F.sin(2 * F.pi() * F.col(frac))
    m = df.select(*keys, c.alias("c"), s.alias("s"), F.col(value).alias("v"))
    every = Window.partitionBy(*keys)
    z = m.select(*keys, *((F.col(k) - F.avg(k).over(every)).alias(k) for k in ("c", "s", "v")))
    g = z.groupBy(*keys).agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in (("c", "c"), ("s", "s"), ("c", "s"), ("c", "v"), ("s", "v"))))
    det = F.expr("cc * ss - cs * cs")
    return g.select(*keys, F.hypot(F.expr("cv * ss - sv * cs") / det, F.expr("sv * cc - cv * cs") / det).alias("amplitude"))
