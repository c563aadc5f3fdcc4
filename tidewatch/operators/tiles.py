"""Sums over pairs of rows of a series, tile by tile.

A statistic on pairs needs n^2 values, but only sums of them by position. A series is handed to its tiles as arrays (n values a column); a tile
makes the pair values of some rows with all others, at most `cells` of them, and reports a few numbers a position. Pairs are never rows, a long
series is many tasks, and tiles add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 2_000_000
#: What a tile makes of its row numbers and the columns of the whole series: for each name an array over all positions.
Tile = Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]]


def columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row a series: (series_id, n) and each column's values in order of t as an array."""
    whole = df.groupBy("series_id", "n").agg(F.array_sort(F.collect_list(F.struct("t", *(F.col(c).cast("double").alias(c) for c in cols)))).alias("_rows"))
    return whole.select("series_id", "n", *(F.col("_rows").getField(c).alias(c) for c in cols))


def tiled(df: DataFrame, cols: Sequence[str], tile: Tile, names: Sequence[str], cells: int = CELLS) -> DataFrame:
    """(series_id, n, t, names): the tiles' arrays added up, for rows (series_id, t, n, cols) with t = 1..n."""
    whole = columns(df, cols)
    size = F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("n"))).cast("long")
    parts = whole.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, size))).withColumn("size", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, first, rows = (batch.column(c)[k].as_py() for c in ("n", "first", "size"))
                values = {c: np.asarray(batch.column(c)[k].values) for c in cols}
                found = tile(np.arange(first, min(first + rows, n)), values)
                ids = batch.column("series_id").take(pa.array(np.full(n, k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, n)), pa.array(np.arange(1, n + 1)), *(pa.array(np.asarray(found[c], float)) for c in names)], ["series_id", "n", "t", *names])

    kind = df.schema["series_id"].dataType.simpleString()
    out = parts.repartition("series_id", "first").mapInArrow(run, f"series_id {kind}, n long, t long, " + ", ".join(f"{c} double" for c in names))
    return out.groupBy("series_id", "n", "t").agg(*(F.sum(c).alias(c) for c in names))


def square_parts(rows: np.ndarray, values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """A tile of a symmetric matrix, summed by the larger and by the smaller index of each pair."""
    n = values.shape[1]
    lower = np.where(np.arange(n) < rows[:, None], values, 0.0)
    own = values[np.arange(len(rows)), rows]
    larger, smaller = np.zeros(n), 2 * lower.sum(axis=0)
    larger[rows] = 2 * lower.sum(axis=1) + own
    smaller[rows] += own
    return {f"{name}_up": larger, f"{name}_down": smaller}


def row_product_parts(rows: np.ndarray, a: np.ndarray, b: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """At each position the sum over a tile's rows of (row sum of a) * (row sum of b) within the left square, and the right square."""
    run_a, run_b = np.cumsum(a, axis=1), np.cumsum(b, axis=1)
    left = np.arange(a.shape[1]) >= rows[:, None]
    rest = (run_a[:, -1:] - run_a) * (run_b[:, -1:] - run_b)
    return {f"{name}_l": np.where(left, run_a * run_b, 0.0).sum(axis=0), f"{name}_r": np.where(left, 0.0, rest).sum(axis=0)}


def squares(sums: DataFrame, names: Sequence[str]) -> DataFrame:
    """From sums by larger and smaller index: those over the left square, the right square and the whole, at each t."""
    to = Window.partitionBy("series_id").orderBy("t")
    after = Window.partitionBy("series_id").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)  # what lies behind t
    every = Window.partitionBy("series_id")
    parts = {f"{c}_l": F.sum(f"{c}_up").over(to) for c in names}
    parts |= {f"{c}_r": F.coalesce(F.sum(f"{c}_down").over(after), F.lit(0.0)) for c in names}
    parts |= {f"{c}_a": F.sum(f"{c}_up").over(every) for c in names}
    return sums.withColumns(parts).drop(*(f"{c}_{k}" for c in names for k in ("up", "down")))


def rank_distance_median(n: int) -> float:
    """The median distance of two of the ranks 1..n over n + 1 (n - k pairs are k apart; of an even number, the middle two's mean)."""
    pairs = n * (n - 1) // 2
    if not pairs:
        return 1.0
    upto = np.cumsum(np.arange(n - 1, 0, -1))
    middle = [int(np.searchsorted(upto, k + 1)) + 1 for k in ((pairs - 1) // 2, pairs // 2)]
    return sum(middle) / 2 / (n + 1)


def rank_square_median(n: int) -> float:
    """Likewise of squared distances."""
    pairs = n * (n - 1) // 2
    if not pairs:
        return 1.0
    upto = np.cumsum(np.arange(n - 1, 0, -1))
    middle = [(int(np.searchsorted(upto, k + 1)) + 1) ** 2 for k in ((pairs - 1) // 2, pairs // 2)]
    return sum(middle) / 2 / (n + 1) ** 2
