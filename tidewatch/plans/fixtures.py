"""Series over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, x, y, n): one series per type of event, t from 1."""
    w = Window.partitionBy("event_type")
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "value", "user_id")
    t = F.row_number().over(w.orderBy("event_id")).cast("long")
    return rows.select(F.col("event_type").alias("series_id"), t.alias("t"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.count("*").over(w).alias("n"))


PAIRS = """
pairs AS (
  SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS t, value AS x, CAST(user_id AS DOUBLE) AS y,
    count(*) OVER (PARTITION BY event_type) AS n FROM events
)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, hour, x, y, n): sums (exact, in cents) and counts per type of event and hour; at most 24 a day."""
    cents = F.round(F.col("value") * 100).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), cents.alias("cents"))
    sums = rows.groupBy("series_id", "hour").agg(F.sum("cents").cast("double").alias("x"), F.count("*").cast("double").alias("y"))
    w = Window.partitionBy("series_id")
    return sums.select("series_id", F.row_number().over(w.orderBy("hour")).cast("long").alias("t"), "hour", "x", "y", F.count("*").over(w).alias("n"))


HOURLY = """
hourly AS (
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY hour) AS t, hour, x, y, count(*) OVER (PARTITION BY series_id) AS n FROM (
    SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY ALL
  )
)"""


def closes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(day, x) from orders and (day, y) from line items: two calendars of days as text, whose order is that of time."""
    total = lambda c: (F.sum(F.round(F.col(c) * 100).cast("long")) / F.lit(100.0))
    a = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(total("o_totalprice").alias("x"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(total("l_extendedprice").alias("y"))
    return a, b


CLOSES = """
closes_a AS (SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS x FROM orders GROUP BY 1),
closes_b AS (SELECT strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS day, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS y FROM lineitem GROUP BY 1)"""


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})
