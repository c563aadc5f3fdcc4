"""Operators on small frames: readers and sinks, two-level forms, moments against NumPy."""

from __future__ import annotations

import gzip
import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import detection as dt
from tidewatch.functions import generators
from tidewatch.functions import spectra as sp
from tidewatch.operators import detect, scans, series
from tidewatch.operators.prefix import ordinal_ranks, running_sums
from tidewatch.sources import readers, writers


@pytest.fixture(scope="module")
def pair(spark):
    z = generators.generate("D1", 0.7, 0)
    return spark.createDataFrame(pd.DataFrame({"series_id": "a", "t": np.arange(1, 601), "x": z[:, 0], "y": z[:, 1], "n": 600})), z


def test_running_sums_in_two_levels(spark):
    df = spark.range(1, 1001).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 13).alias("v"))
    one = running_sums(df, ["k"], "t", {"s": "v"}).orderBy("t").toPandas()["s"].tolist()
    assert running_sums(df, ["k"], "t", {"s": "v"}, block=64).orderBy("t").toPandas()["s"].tolist() == one


def test_ranks_in_two_levels(spark):
    df = spark.range(1, 501).select(F.lit(0).alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 50).cast("double").alias("v"))
    one = ordinal_ranks(df, ["k"], ["v", "t"], "r").orderBy("t").toPandas()["r"].tolist()
    assert ordinal_ranks(df, ["k"], ["v", "t"], "r", [10.0, 25.0, 40.0]).orderBy("t").toPandas()["r"].tolist() == one


def test_spearman_scan_equals_numpy(pair):
    df, z = pair
    u = np.column_stack([sp.ranks01(z[:, 0]), sp.ranks01(z[:, 1])]) - 0.5

    def rho(part):
        c = np.cov(part.T, bias=True)
        return c[0, 1] / np.sqrt(c[0, 0] * c[1, 1] + 1e-12)

    t = 250
    expected = np.sqrt(t * (600 - t) / 600) * abs(rho(u[:t]) - rho(u[t:]))
    assert scans.spearman_scan(df).filter(f"t = {t}").first().q == pytest.approx(expected, abs=1e-9)


def test_moments_and_curve_equal_numpy(pair):
    df, z = pair
    fx, fy = sp.pair_features(z[:, 0], z[:, 1])
    m = detect.interval_moments(df, 60).orderBy("interval").toPandas()
    assert m["cnt"].tolist() == [60] * 10
    assert np.stack(m["mx"]).sum(axis=0) == pytest.approx((fx.T @ fx).ravel(), abs=1e-9)
    got = detect.moment_curve(detect.interval_moments(df, 60)).orderBy("interval").toPandas()
    grid = 60 * got["interval"].to_numpy()
    assert got["q"].to_numpy() == pytest.approx(dt.information_curve(fx, fy, grid, entropy=sp.ent14), abs=1e-9)


def test_moment_test_rejects_a_break(pair):
    row = detect.moment_test(detect.interval_moments(pair[0], 12), 59, 3, 1).first()
    assert row.p <= 0.05 and abs(row.tau * 12 - 300) <= 72


def test_no_rows_give_no_rows(spark):
    empty = spark.createDataFrame([], "series_id string, t long, x double, y double, n long")
    assert scans.spearman_scan(empty).count() == 0
    assert scans.gram_order2_scan(empty).count() == 0
    assert detect.moment_curve(detect.interval_moments(empty, 10)).count() == 0


def test_archive_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tm,stn,ta,wd,ws,td,hm,pa,ps,rn\n202001010000,108,1.5,0,0,0,NA,0,0,0\n202001010100,108,-99,0,0,0,5,0,0,0\n202001010100,999,3,0,0,0,5,0,0,0\n")
    daily = readers.archive(spark, str(tmp_path / "*.csv"), ["108"], ["ta", "hm"], floor=-90)
    assert [tuple(r) for r in daily.orderBy("tm").collect()] == [("202001010000", "108", 1.5, None), ("202001010100", "108", None, 5.0)]
    hourly = readers.archive(spark, str(tmp_path / "*.csv"), ["108"], ["ta"])
    assert [r.ta for r in hourly.orderBy("tm").collect()] == [1.5, -99.0]
    out = series.daily_means(daily, ["stn"], F.substring("tm", 1, 8), "ta").first()
    assert (out.mean, out.n) == (1.5, 1)


def test_chart_and_closes(spark, tmp_path):
    chart = {"chart": {"result": [{"meta": {"gmtoffset": -18000}, "timestamp": [86400, 172800, 259200], "indicators": {"quote": [{"close": [1.5, None, 0.0]}]}}]}}
    (tmp_path / "c.json").write_text(json.dumps(chart))
    assert [tuple(r) for r in readers.chart(spark, str(tmp_path / "c.json")).collect()] == [("19700101", 1.5)]
    (tmp_path / "k.csv").write_text("date,close\n20200101,1.0\n20200102,2.0\n20200102,3.0\n20200103,-1\n")
    assert sorted(tuple(r) for r in readers.closes(spark, str(tmp_path / "k.csv")).collect()) == [("20200101", 1.0), ("20200102", 3.0)]


def test_records_and_fingerprints(spark, tmp_path):
    with gzip.open(tmp_path / "r.csv.gz", "wt") as f:
        f.write("a,b\n1,x\n")
    assert readers.records(spark, str(tmp_path / "r.csv.gz")).first().a == 1
    (tmp_path / "r.jsonl").write_text('{"p": {"s": 0.5}}\n')
    assert readers.records(spark, str(tmp_path / "r.jsonl")).first().p.s == 0.5
    good = hashlib.sha256((tmp_path / "r.jsonl").read_bytes()).hexdigest()
    readers.checked(spark, str(tmp_path / "r.jsonl"), {"r.jsonl": good})
    with pytest.raises(ValueError):
        readers.checked(spark, str(tmp_path / "r.jsonl"), {"r.jsonl": "0"})


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "records")
    writers.append_records(spark.createDataFrame([(1, 2.0)], "k int, a double"), path)
    writers.append_records(spark.createDataFrame([(2, "z")], "k int, b string"), path)
    assert sorted(tuple(r) for r in writers.read_records(spark, path).select("k", "a", "b").collect()) == [(1, 2.0, None), (2, None, "z")]
    done = writers.read_records(spark, path)
    assert [r.k for r in writers.unfinished(spark.range(1, 4).select(F.col("id").cast("int").alias("k")), done, ["k"]).collect()] == [3]
    writers.write_aggregate(done.select("k"), str(tmp_path / "agg"))
    assert spark.read.csv(str(tmp_path / "agg"), header=True).count() == 2
    writers.write_aggregate(done.select("k"), str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_monitor_equals_batch(spark, tmp_path):
    from tidewatch.streaming.monitor import interval_sums

    rows = spark.range(1000).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.lit("a").alias("series_id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = interval_sums(stream, "1 hour", "10 minutes").writeStream.outputMode("append").format("memory").queryName("monitor").start()
    q.processAllAvailable()
    q.stop()
    got = {r.start: r.sxy for r in spark.table("monitor").collect()}
    batch = {r.start: r.sxy for r in interval_sums(rows, "1 hour", None).collect()}
    assert len(got) >= 14 and all(batch[k] == v for k, v in got.items())


def test_long_series(spark):
    """A series of four million rows: ranks in ranges, running sums in blocks, sums of products beyond 64 bits."""
    from tidewatch.operators import scans

    n = 4_000_000
    rows = spark.range(1, n + 1, numPartitions=16).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.lit(n).cast("long").alias("n"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) * 1.0).alias("x"))
    late = F.col("t") > n // 2
    rows = rows.withColumn("y", F.when(late, F.col("x")).otherwise(F.pmod(F.xxhash64("t", F.lit(1)), F.lit(1_000_003)) * 1.0))
    top = scans.spearman_scan(rows, w=1000, block=1 << 19, ranges=1 << 19).agg(F.max("q"), F.max_by("t", "q"), F.count("*")).first()
    assert top[2] == n - 1999
    assert abs(top[1] - n // 2) < 5000 and top[0] == pytest.approx(math.sqrt(n / 4), rel=0.02)


def test_ranks_and_moments_in_ranges(spark):
    from tidewatch.operators import detect, scans

    rng = np.random.default_rng(3)
    rows = [(s, t + 1, 700, float(np.round(rng.normal(), 1)), float(rng.normal())) for s in "ab" for t in range(700)]
    df = spark.createDataFrame(rows, "series_id string, t long, n long, x double, y double")
    plain = {(r.series_id, r.t): r.q for r in scans.spearman_scan(df).collect()}
    assert {(r.series_id, r.t): r.q for r in scans.spearman_scan(df, block=128, ranges=300).collect()} == pytest.approx(plain)
    cells = lambda m: {(r.series_id, r.interval): sum(r.mj) for r in m.collect()}
    assert cells(detect.interval_moments(df, pieces=10, ranges=200)) == pytest.approx(cells(detect.interval_moments(df, pieces=10)))


def test_printed_arrays_and_changed_inputs(spark, tmp_path):
    frame = spark.createDataFrame([("[1, 2.5  3]",), ("[]",), (None,), ("(4,)",)], "v string").select(readers.printed_array("v").alias("a"))
    assert [r.a for r in frame.collect()] == [[1.0, 2.5, 3.0], [], None, [4.0]]
    (tmp_path / "a.bin").write_bytes(b"x")
    with pytest.raises(ValueError, match="b.bin"):
        readers.checked(spark, str(tmp_path / "*.bin"), {"a.bin": hashlib.sha256(b"x").hexdigest(), "b.bin": "0"})
