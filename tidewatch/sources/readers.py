"""Readers of the inputs that the engine takes: CSV archives, nested charts, keyed closes, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.series import missing_to_null

#: Columns of a station archive file, in order.
ARCHIVE = "tm string, stn string, ta string, wd string, ws string, td string, hm string, pa string, ps string, rn string"
CHART = "chart struct<result: array<struct<meta: struct<gmtoffset: long>, timestamp: array<long>, indicators: struct<quote: array<struct<close: array<double>>>>>>>"


def archive(spark: SparkSession, path: str, stations: list[str], columns: list[str], floor: float | None = None) -> DataFrame:
    """Hourly rows of the given stations from a glob of CSV files; the station filter reaches the scan, unreadable files are skipped.

    floor: values up to it are missing codes (the daily form); None keeps them (the hourly form).
    """
    rows = spark.read.option("ignoreCorruptFiles", True).option("mode", "PERMISSIVE").csv(path, header=True, schema=ARCHIVE)
    return rows.filter(F.col("stn").isin(*stations)).select("tm", "stn", *(missing_to_null(F.col(c), floor).alias(c) for c in columns))


def chart(spark: SparkSession, path: str) -> DataFrame:
    """(date, close) of a nested chart file: positive closes, dates in the exchange's zone."""
    one = spark.read.json(path, schema=CHART, multiLine=True).select(F.element_at("chart.result", 1).alias("r"))
    rows = one.select(F.col("r.meta.gmtoffset").alias("offset"), F.explode(F.arrays_zip(F.col("r.timestamp").alias("ts"), F.element_at("r.indicators.quote", 1)["close"].alias("close"))).alias("p"))
    day = F.date_format(F.timestamp_seconds(F.col("p")["ts"] + F.col("offset")), "yyyyMMdd")
    return rows.select(day.alias("date"), F.col("p")["close"].alias("close")).filter("close > 0")


def closes(spark: SparkSession, path: str, first: str = "0", last: str = "9") -> DataFrame:
    """(date, close) of a keyed CSV file: the last row of a date counts, positive closes within the range."""
    rows = spark.read.csv(path, header=True, schema="date string, close double").withColumn("_at", F.monotonically_increasing_id())
    return rows.filter((F.col("close") > 0) & F.col("date").between(first, last)).groupBy("date").agg(F.max_by("close", "_at").alias("close"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results: CSV (also gzip) or JSON lines, by the file's name."""
    return spark.read.json(path) if ".json" in path else spark.read.csv(path, header=True, inferSchema=True)


def printed_array(column: str) -> Column:
    """A list of numbers that was printed to text, with brackets, commas or blanks: as an array; empty for an empty list, null for null."""
    parts = F.filter(F.split(F.translate(column, "[](),", "     "), r"\s+"), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast("double"))


#: Bytes of a file that is taken as one value to be fingerprinted.
WHOLE = 1 << 30


def checked(spark: SparkSession, path: str, fingerprints: dict[str, str]) -> None:
    """Raise if the SHA-256 of a file isn't the one that was noted; only files that differ come to the driver."""
    files = spark.read.format("binaryFile").load(path)
    large = files.filter(F.col("length") > WHOLE).select("path").limit(1).collect()
    if large:
        raise ValueError(f"{large[0][0]} has more than {WHOLE} bytes: fingerprint it by its rows")
    noted = spark.createDataFrame(list(fingerprints.items()), "name string, noted string")
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("seen"))
    wrong = noted.join(found, "name", "left").filter(~F.col("seen").eqNullSafe(F.col("noted"))).select("name").limit(20).collect()
    if wrong:
        raise ValueError(f"inputs changed: {', '.join(sorted(r[0] for r in wrong))}")


def json_fields(df: DataFrame, col: str, schema: str) -> DataFrame:
    """The fields of a JSON column as columns."""
    return df.withColumn("_j", F.from_json(col, schema)).select(*df.columns, "_j.*")
