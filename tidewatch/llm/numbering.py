"""Global row numbers that depend on the rows alone, not on how they are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket holds on average where the table is large, and how many times that makes a bucket hot.
ROWS, HOT = 200_000, 5


def numbered(rows: DataFrame, keys: list[str], name: str, lead: Column | None = None, leads: int = 1, per_bucket: int = ROWS) -> DataFrame:
    """Add `name`: numbers 0, 1, 2, ... without a gap, rows of a smaller `lead` (0 to leads-1) first. The rows must be kept (checkpointed).

    Rows go to hash buckets of their keys, so many that one holds `per_bucket` rows on average. The buckets' sizes give each bucket's first
    number, and a bucket is ordered by the keys. Rows that agree in all keys are numbered in any order; a bucket that very many such rows make
    hot is numbered from the counts of its keys in each partition, so that no task holds the rows of a key.
    """
    each = max(1, -(-rows.count() // per_bucket))
    hashed = F.pmod(F.xxhash64(*keys), F.lit(each)).cast("long")
    marked = rows.withColumn("_bucket", hashed if lead is None else lead.cast("long") * each + hashed).withColumn("_part", F.spark_partition_id())
    sizes = marked.groupBy("_bucket").agg(F.count("*").alias("_size"))
    ahead = F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")
    first = sizes.select(F.col("_bucket"), ahead.alias("_first"))
    hot = sizes.filter(F.col("_size") > HOT * per_bucket).select("_bucket")
    if hot.isEmpty():
        return _ordered(marked, keys, first, name)
    cool = _ordered(marked.join(hot, "_bucket", "left_anti"), keys, first, name)
    return cool.unionByName(_counted(marked.join(hot, "_bucket", "left_semi"), keys, first, name))


def _ordered(marked: DataFrame, keys: list[str], first: DataFrame, name: str) -> DataFrame:
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)).cast("long") - 1
    return marked.withColumn("_within", within).join(first, "_bucket").withColumn(name, F.col("_first") + F.col("_within")).drop("_bucket", "_part", "_within", "_first")


def _counted(marked: DataFrame, keys: list[str], first: DataFrame, name: str) -> DataFrame:
    """The same numbers without sorting a bucket's rows: keys are ordered, then partitions, then the rows of one key in one partition."""
    dealt = marked.withColumn("_key", F.struct(*keys))
    counts = dealt.groupBy("_bucket", "_key", "_part").agg(F.count("*").alias("_n"))
    sofar = Window.partitionBy("_bucket").orderBy("_key", "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.withColumn("_ahead", F.sum("_n").over(sofar) - F.col("_n")).join(first, "_bucket")
    starts = starts.select(F.col("_key").alias("_of"), F.col("_part").alias("_in"), (F.col("_first") + F.col("_ahead")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(F.lit(0))).cast("long") - 1
    found = dealt.withColumn("_within", within).join(starts, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")))
    return found.withColumn(name, F.col("_start") + F.col("_within")).drop("_bucket", "_part", "_key", "_of", "_in", "_start", "_within")
