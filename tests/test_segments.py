"""Partitions and split gains made from the sums of grid cells: no row a segment, and segments without values."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SF, plain
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewatch.functions import detection as dt
from tidewatch.functions import generators
from tidewatch.operators import evaluate, segment


@pytest.fixture(scope="module")
def two(spark):
    """Two series of 600 rows, 60 cells of ten rows."""
    z = [generators.generate(name, 0.7, 0) for name in ("D1", "S1")]
    return spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": str(k), "t": np.arange(1, 601), "x": v[:, 0], "y": v[:, 1], "n": 600}) for k, v in enumerate(z)]))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Events by turns of five types, 700 each: one as it is, one without values in the first cell, one within, one nowhere a value, one with a NaN."""
    out = tmp_path_factory.mktemp("odd")
    k = np.arange(3500)
    rng = np.random.default_rng(5)
    value = pd.Series(rng.normal(50, 9, 3500).round(2), dtype="Float64")
    kind, t = k % 5, k // 5
    value[(kind == 1) & (t < 100) | (kind == 2) & (t >= 200) & (t < 400) | (kind == 3)] = pd.NA
    frame = pd.DataFrame({"event_id": k, "user_id": rng.integers(1, 900, 3500), "event_type": np.array(list("abcde"))[kind], "value": value})
    con = duckdb.connect()
    con.sql(f"COPY (SELECT event_id, user_id, event_type, CASE WHEN event_id = 1754 THEN 'nan'::DOUBLE ELSE value END AS value FROM frame) TO '{out}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{out}/events.parquet'")
    return str(out), con


WITHOUT_COSTS = ["l4_optimal_partition", "l6_calibrated_penalty", "l6_penalty_path", "m13_split_gains"]


@pytest.mark.parametrize("name", WITHOUT_COSTS)
def test_costs_are_not_rows(name, spark):
    """Joins of edges make a row a segment, and arrays of them a series in one row."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("name", WITHOUT_COSTS)
def test_segments_without_values(name, spark, odd):
    path, con = odd
    got = entry.queries()[name](spark, path).toPandas()
    assert plain(got) == plain(con.sql(entry.oracle_sql()[name]).df())


def test_partitions_equal_the_fold(spark, two):
    arrays = segment.cost_arrays(segment.gauss_costs(two, 10))
    for beta in (0.5, 8.0):
        slow = segment.optimal_partition(arrays, F.lit(beta)).orderBy("series_id").collect()
        got = segment.gauss_partitions(two, 10, [beta, 3.0]).filter(F.col("beta") == beta).orderBy("series_id").collect()
        assert [r.cuts for r in got] == [r.cuts for r in slow] and any(r.cuts for r in got)
        assert [r.value for r in got] == pytest.approx([r.value for r in slow], abs=1e-8)


def test_split_gains_equal_the_joins(spark, two):
    slow = evaluate.split_gains(segment.gauss_costs(two, 10)).orderBy("series_id", "i", "t", "j").toPandas()
    got = segment.gauss_split_gains(two, 10).orderBy("series_id", "i", "t", "j").toPandas()
    assert got.columns.tolist() == slow.columns.tolist() and got.dtypes.tolist() == slow.dtypes.tolist()
    pd.testing.assert_frame_equal(got, slow, check_exact=False, atol=1e-8)


def test_split_gains_in_pieces():
    """Every triple once, however the starts are dealt out and however few values are made at a time."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(12, 10, 2))
    x, y = z[..., 0], z[..., 1]
    cells = np.array([np.full(12, 10.0), *(v.sum(1) for v in (x, y, x * x, y * y, x * y)), *np.full((3, 12), 10.0)])

    def triples(parts, most):
        found = [(s, t, t + 1 + k, g) for first in range(parts) for i, t, gain, _ in dt.gauss_split_gains(cells, first, parts, 1e-6, most) for s, row in zip(i, gain) for k, g in enumerate(row)]
        return sorted(found)

    assert [v[:3] for v in triples(1, 1000)] == [(i, t, j) for i in range(13) for t in range(i + 1, 13) for j in range(t + 1, 13)]
    assert triples(3, 1) == triples(5, 30) == triples(1, 1000)


def test_split_gains_are_rounded_as_spark_does(spark, two):
    keys = ["series_id", "i", "t", "j"]
    slow = segment.gauss_split_gains(two, 10).withColumn("gain", F.round("gain", 1)).orderBy(*keys).toPandas()
    got = segment.gauss_split_gains(two, 10, digits=1).orderBy(*keys).toPandas()
    pd.testing.assert_frame_equal(got, slow, check_exact=True)
    assert not (np.signbit(got.gain) & (got.gain == 0)).any()


def test_starts_of_split_gains_change_fastest(spark, two):
    """75 cells, so two tasks a series have every second start; in files, splits and ends that stay the same over many rows take next to nothing."""
    keys = ["series_id", "i", "t", "j"]
    got = segment.gauss_split_gains(two, 8).toPandas()
    changes = (got[["series_id", "t", "j"]] != got[["series_id", "t", "j"]].shift()).any(axis=1).sum()
    assert changes == 2 * sum(75 - t for first in range(2) for t in range(first + 1, 75))
    slow = evaluate.split_gains(segment.gauss_costs(two, 8)).orderBy(*keys).toPandas()
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), slow, check_exact=False, atol=1e-8)
