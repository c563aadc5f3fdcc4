"""A stream of pairs summed to interval moments: what the scans need, kept up to date with late rows allowed for.

An extension beyond batch use: windows of event time per series, closed by the watermark, each with its count and second moments. The
closed intervals are rows that the interval scans and their running sums take as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_sums(rows: DataFrame, length: str, late: str | None) -> DataFrame:
    """(series_id, start, cnt, sx, sy, sxx, syy, sxy) of rows (series_id, ts, x, y); `late`: the watermark's delay on a stream."""
    timed = rows.withWatermark("ts", late) if late else rows
    sums = {"sx": "x", "sy": "y", "sxx": "x * x", "syy": "y * y", "sxy": "x * y"}
    out = timed.groupBy("series_id", F.window("ts", length).alias("w")).agg(F.count("*").alias("cnt"), *(F.sum(F.expr(e)).alias(n) for n, e in sums.items()))
    return out.select("series_id", F.col("w.start").alias("start"), "cnt", *sums)
