"""Building series: returns, sums over blocks, labels, anomalies, alignment of calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_to_null(col: Column, floor: float | None = None) -> Column:
    """Text or numbers as double; blanks, NA, None and NaN, and codes up to `floor`, are null."""
    text = F.trim(col.cast("string"))
    value = F.when(F.upper(text).isin("", "NA", "NONE", "NAN"), None).otherwise(text.try_cast("double"))
    value = F.when(F.isnan(value), None).otherwise(value)
    return value if floor is None else F.when(value > floor, value)


def daily_means(df: DataFrame, keys: Sequence[str], day: Column, col: str, digits: int = 3, floor: float = -90.0) -> DataFrame:
    """Mean (rounded) and count per day of the values above the missing code."""
    kept = df.withColumn("_v", missing_to_null(F.col(col), floor))
    return kept.groupBy(*keys, day.alias("day")).agg(F.round(F.avg("_v"), digits).alias("mean"), F.count("_v").alias("n"))


def differences(df: DataFrame, keys: Sequence[str], order: str, col: str, name: str, log: bool = False) -> DataFrame:
    """First differences (of logarithms); the first row of a series goes."""
    value = F.log(col) if log else F.col(col)
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(name, value - before).filter(F.col(name).isNotNull())


def block_sums(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], k: int, keep_short: bool = False) -> DataFrame:
    """Sums over k rows in turn, named by the first row of the block; a short last block goes unless kept."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    out = df.withColumn("block", F.floor(at / k).cast("long")).groupBy(*keys, "block").agg(F.min(order).alias("start"), F.count("*").alias("size"), *(F.sum(c).alias(c) for c in cols))
    return out if keep_short else out.filter(F.col("size") == k)


def season(month: Column) -> Column:
    """0 winter, 1 spring, 2 summer, 3 autumn."""
    return F.floor((month % 12) / 3).cast("int")


#: Days before each month of a year of 365 days.
DAYS_BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def year_fraction(day: Column) -> Column:
    """Year and share of a year of 365 days, leap days not told apart."""
    before = F.element_at(F.array(*map(F.lit, DAYS_BEFORE)), F.month(day))
    return F.year(day) + (before + F.dayofmonth(day) - 1) / F.lit(365.0)


def climatology_anomaly(df: DataFrame, keys: Sequence[str], ts: str, col: str, half: int = 7) -> DataFrame:
    """The value less the mean of its station and hour over all rows within `half` days of the year, around the year's end too.

    Sums and counts per day of the year are made first, so each day spreads 2 half + 1 small rows, not each observation.
    """
    named = df.withColumn("_hour", F.hour(ts)).withColumn("_day", F.dayofyear(ts))
    day = named.groupBy(*keys, "_hour", "_day").agg(F.sum(col).alias("_s"), F.count(col).alias("_n"))
    near = day.withColumn("_day", F.explode(F.expr(f"transform(sequence(-{half}, {half}), d -> pmod(_day - 1 + d, 366) + 1)")))
    mean = near.groupBy(*keys, "_hour", "_day").agg((F.sum("_s") / F.sum("_n")).alias("_mean"))
    return named.join(mean, [*keys, "_hour", "_day"]).withColumn("anomaly", F.col(col) - F.col("_mean")).drop("_hour", "_day", "_mean")


def position_anomaly(df: DataFrame, keys: Sequence[str], order: str, col: str, period: int = 365) -> DataFrame:
    """The value less the mean of its position modulo the period, where there are several."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    same = Window.partitionBy(*keys, "_at")
    mean = F.when(F.count(col).over(same) > 1, F.avg(col).over(same)).otherwise(0.0)
    return df.withColumn("_at", at % period).withColumn("anomaly", F.col(col) - mean).drop("_at")


def alternating_split(df: DataFrame, t: str, block: int, trim: int, keys: Sequence[str] = ()) -> DataFrame:
    """Half A or B by turns of `block` rows (positions from 0), without `trim` rows at either end of a block and without the rest."""
    last = df.groupBy(*keys).agg((F.max(t) + 1).alias("_n"))  # one row a series, or one
    named = df.join(last, list(keys)) if keys else df.crossJoin(F.broadcast(last))
    inside = (F.col(t) % block >= trim) & (F.col(t) % block < block - trim) & (F.col(t) < F.floor(F.col("_n") / block) * block)
    return named.filter(inside).withColumn("half", F.when(F.floor(F.col(t) / block) % 2 == 0, "A").otherwise("B")).drop("_n")


def window_around(df: DataFrame, candidates: DataFrame, keys: Sequence[str], t: str, unit: int, half: int) -> DataFrame:
    """The rows around each candidate (key columns, at): so many whole units on either side, clipped at the ends."""
    at = candidates.withColumn("_lo", (F.floor(F.col("at") / unit) - half) * unit).withColumn("_hi", (F.floor(F.col("at") / unit) + half) * unit)
    return df.join(at, list(keys)).filter((F.col(t) >= F.col("_lo")) & (F.col(t) < F.col("_hi"))).drop("_lo", "_hi")


def aligned_first(a: DataFrame, b: DataFrame, order: str, x: str, y: str) -> DataFrame:
    """Common days first, then differences of logarithms: what lies between two common days counts whole."""
    both = a.join(b, order).withColumn("_g", F.lit(0))
    w = Window.partitionBy("_g").orderBy(order)
    out = both.withColumns({"dx": F.log(x) - F.lag(F.log(x)).over(w), "dy": F.log(y) - F.lag(F.log(y)).over(w)})
    return out.filter(F.col("dx").isNotNull()).select(order, "dx", "dy")


def differenced_first(a: DataFrame, b: DataFrame, order: str, x: str, y: str) -> DataFrame:
    """Each series on its own calendar, then the days that both have."""
    one = lambda df, c, n: differences(df.withColumn("_g", F.lit(0)), ["_g"], order, c, n, True).select(order, n)
    return one(a, x, "dx").join(one(b, y, "dy"), order)


def latest_before(left: DataFrame, right: DataFrame, order: str, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each left row with the value of the last right row strictly before it, by one sort of both sides."""
    one = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(0).alias("_side"))
    other = right.select(*keys, order, F.col(value).alias("_v")).withColumn("_side", F.lit(1))
    every = one.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn(name, F.last("_v", ignorenulls=True).over(w)).filter("_side = 0").drop("_v", "_side")


def near(a: DataFrame, b: DataFrame, keys: Sequence[str], t: str, within: int) -> DataFrame:
    """Pairs of rows of the same keys at most `within` apart: an equality join on cells of that width, then the distance."""
    left = a.withColumn("_cell", F.explode(F.array(*[F.floor(F.col(t) / within) + k for k in (-1, 0, 1)])))
    right = b.withColumn("_cell", F.floor(F.col(t) / within)).withColumnRenamed(t, f"{t}_b")
    return left.join(right, [*keys, "_cell"]).filter(F.abs(F.col(t) - F.col(f"{t}_b")) <= within).drop("_cell")


def half_even(col: Column, step: float) -> Column:
    """Rounded to multiples of the step, ties to even."""
    return F.bround(col / F.lit(step)) * F.lit(step)


def segment_label(t: Column, cuts: Column) -> Column:
    """Number of change points at or before t."""
    return F.size(F.filter(cuts, lambda c: c <= t))


def sliding(df: DataFrame, keys: Sequence[str], order: str, col: str, size: int) -> DataFrame:
    """All full windows of `size` rows as arrays, named by their first row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, size - 1)
    return df.withColumn("window", F.collect_list(col).over(w)).filter(F.size("window") == size)


def quantile_map(df: DataFrame, keys: Sequence[str], col: str, p: str, name: str) -> DataFrame:
    """The linearly interpolated order statistic of the group's values at each row's level p."""
    values = df.groupBy(*keys).agg(F.sort_array(F.collect_list(col)).alias("_v"))
    at = F.col(p) * (F.size("_v") - 1)
    low = F.floor(at).cast("int")
    a, b = F.element_at("_v", low + 1), F.element_at("_v", F.least(low + 2, F.size("_v")))
    return df.join(values, list(keys)).withColumn(name, a + (b - a) * (at - low)).drop("_v")


def upsampled(df: DataFrame, col: str, constant: float) -> DataFrame:
    """The vectors with a constant coordinate behind, so that second moments hold the mean."""
    return df.withColumn(col, F.concat(col, F.array(F.lit(constant))))
