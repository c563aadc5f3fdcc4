"""Queries: sources, series building, joins, ranks, windows and plain aggregates (A, C, D, E, F)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import ranks, series
from tidewatch.operators.prefix import ordinal_ranks
from tidewatch.plans.fixtures import CLOSES, HOURLY, PAIRS, closes, hourly, pairs, rounded, table
from tidewatch.plans.registry import query
from tidewatch.sources import readers, writers
from tidewatch.sources.readers import json_fields

KEY = ["series_id"]


# ---- sources (A): the readers' rules on the driver's tables; the file readers themselves are tested on files


@query("""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(avg(CASE WHEN value > 1 THEN value END), 3) AS mean, count(CASE WHEN value > 1 THEN 1 END) AS n
FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL""")
def a1_daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return series.daily_means(rows, ["event_type"], F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), "value", 3, 1.0)


@query("""SELECT event_type, strftime(ts, '%Y%m%d%H%M') AS tm, value FROM events WHERE event_type IN ('click', 'view')""")
def a2_keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return rows.select("event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmm").alias("tm"), series.missing_to_null(F.col("value")).alias("value"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d') AS local_day FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 0""")
def a3_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json_fields(table(spark, sf_dir, "events"), "props", "k long").filter("k > 0")
    return rows.select("event_id", "k", F.date_format((F.col("ts").cast("timestamp") + F.expr("INTERVAL 9 HOURS")), "yyyyMMdd").alias("local_day"))


@query("""SELECT strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS date, arg_max(o_totalprice, o_orderkey) AS close FROM orders WHERE o_totalprice > 0 AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1""")
def a4_keyed_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_totalprice > 0").filter(F.col("o_orderdate").between(F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1997-12-31"))))
    return rows.groupBy(F.date_format(F.to_date("o_orderdate"), "yyyyMMdd").alias("date")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))


@query("""SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS t, value AS x, user_id AS y FROM events WHERE value IS NOT NULL AND isfinite(value) AND user_id IS NOT NULL AND value > 2""")
def a5_finite_rows_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("value IS NOT NULL AND NOT isnan(value) AND user_id IS NOT NULL AND value > 2")
    t = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).cast("long")
    return rows.select(F.col("event_type").alias("series_id"), t.alias("t"), F.col("value").alias("x"), F.col("user_id").alias("y"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT sha256(props)) AS fingerprints, min(sha256(props)) AS first FROM events GROUP BY 1""")
def a7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.sha2(F.col("props"), 256)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(code).alias("fingerprints"), F.min(code).alias("first"))


@query("""SELECT 'orders' AS source, CAST(o_orderkey AS BIGINT) AS key, o_totalprice AS price, NULL::DOUBLE AS discount FROM orders
UNION ALL SELECT 'lineitem', CAST(l_orderkey AS BIGINT), l_extendedprice, l_discount FROM lineitem""")
def b1_schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").selectExpr("'orders' AS source", "o_orderkey AS key", "o_totalprice AS price")
    b = table(spark, sf_dir, "lineitem").selectExpr("'lineitem' AS source", "l_orderkey AS key", "l_extendedprice AS price", "l_discount AS discount")
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT o_orderstatus AS scen, 'mean' AS method, avg(o_totalprice) > 0 AS ok, format('{:.2f}', round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e2 / count(*), 2)) AS printed, 'orders' AS file FROM orders GROUP BY 1""")
def b4_provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.lit(100.0) / F.count("*")
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("scen")).agg((F.avg("o_totalprice") > 0).alias("ok"), F.format_string("%.2f", F.round(mean, 2)).alias("printed"))
    return out.select("scen", F.lit("mean").alias("method"), "ok", "printed", F.lit("orders").alias("file"))


_AGGREGATE = """SELECT o_orderpriority AS method, o_orderstatus AS scen, count(*) AS n_reps, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL"""


@query(_AGGREGATE)
def b2_written_and_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates as one CSV file and one of JSON lines, joined after reading: both hold the same rows."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("scen")).agg(F.count("*").alias("n_reps"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    folder = writers.scratch(spark)
    for kind in ("csv", "json"):
        writers.write_aggregate(rows, f"{folder}/{kind}", kind)
    back = spark.read.csv(f"{folder}/csv", header=True, schema="method string, scen string, n_reps long, cents long")
    return back.join(spark.read.schema("method string, scen string, n_reps long, cents long").json(f"{folder}/json"), ["method", "scen", "n_reps", "cents"])


@query("""SELECT CAST(o_custkey AS BIGINT) AS key, count(*) AS n, CAST(max(o_orderkey) AS DOUBLE) AS last FROM orders GROUP BY 1""")
def a6_result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed result files with printed lists, read back: their lengths and last entries."""
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    printed = lists.select("key", F.concat(F.lit("["), F.array_join(F.transform("keys", lambda k: k.cast("string")), ", "), F.lit("]")).alias("cps"))
    folder = writers.scratch(spark)
    printed.write.option("header", True).option("compression", "gzip").csv(folder)
    back = spark.read.csv(folder, header=True, schema="key long, cps string").withColumn("cps", readers.printed_array("cps"))
    return back.select("key", F.size("cps").cast("long").alias("n"), F.element_at("cps", -1).alias("last"))


# ---- series building (C)


@query(f"WITH {CLOSES} SELECT day, round(dx, 9) AS dx FROM (SELECT day, ln(x) - lag(ln(x)) OVER (ORDER BY day) AS dx FROM closes_a) WHERE dx IS NOT NULL")
def c1_log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = closes(spark, sf_dir)
    return rounded(series.differences(a.withColumn("g", F.lit(0)), ["g"], "day", "x", "dx", log=True).select("day", "dx"), "dx", digits=9)


def _cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closes(spark, sf_dir)[0].select(F.lit("a").alias("series_id"), "day", F.round(F.col("x") * 100).cast("long").alias("cents"))


@query(f"WITH {CLOSES}, r AS (SELECT day, CAST(round(x * 100) AS BIGINT) AS cents, row_number() OVER (ORDER BY day) - 1 AS k FROM closes_a) SELECT 'a' AS series_id, CAST(k // 21 AS BIGINT) AS block, min(day) AS start, count(*) AS size, CAST(sum(cents) AS BIGINT) AS cents FROM r GROUP BY k // 21 HAVING count(*) = 21")
def c2_block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.block_sums(_cents(spark, sf_dir), KEY, "day", ["cents"], 21)


@query(f"WITH {CLOSES}, r AS (SELECT day, CAST(round(x * 100) AS BIGINT) AS cents, row_number() OVER (ORDER BY day) - 1 AS k FROM closes_a) SELECT 'a' AS series_id, CAST(k // 50 AS BIGINT) AS block, min(day) AS start, count(*) AS size, CAST(sum(cents) AS BIGINT) AS cents FROM r GROUP BY k // 50")
def c3_unit_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.block_sums(_cents(spark, sf_dir), KEY, "day", ["cents"], 50, keep_short=True)


@query(f"WITH {PAIRS} SELECT series_id, CAST((t - 1) // 336 AS BIGINT) AS interval, min(t) - 1 AS lo, max(t) AS hi, count(*) AS cnt FROM pairs GROUP BY ALL")
def c4_interval_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor((F.col("t") - 1) / 336).cast("long")
    return pairs(spark, sf_dir).groupBy("series_id", at.alias("interval")).agg((F.min("t") - 1).alias("lo"), F.max("t").alias("hi"), F.count("*").alias("cnt"))


@query("""WITH e AS (SELECT event_id AS t, value, (SELECT max(event_id) + 1 FROM events) AS n FROM events)
SELECT t, value, CASE WHEN (t // 1008) % 2 = 0 THEN 'A' ELSE 'B' END AS half FROM e WHERE t % 1008 BETWEEN 24 AND 983 AND t < (n // 1008) * 1008""")
def c5_alternating_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.alternating_split(table(spark, sf_dir, "events").select(F.col("event_id").alias("t"), "value"), "t", 1008, 24)


@query("SELECT o_orderkey, CAST(CASE month(o_orderdate) WHEN 12 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 7 THEN 2 WHEN 8 THEN 2 ELSE 3 END AS INTEGER) AS season FROM orders")
def c6_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", series.season(F.month("o_orderdate")).alias("season"))


@query("SELECT o_orderkey, round(year(o_orderdate) + (CASE month(o_orderdate) WHEN 1 THEN 0 WHEN 2 THEN 31 WHEN 3 THEN 59 WHEN 4 THEN 90 WHEN 5 THEN 120 WHEN 6 THEN 151 WHEN 7 THEN 181 WHEN 8 THEN 212 WHEN 9 THEN 243 WHEN 10 THEN 273 WHEN 11 THEN 304 ELSE 334 END + day(o_orderdate) - 1) / 365e0, 9) AS frac FROM orders")
def c7_year_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", series.year_fraction(F.col("o_orderdate")).alias("frac")), "frac", digits=9)


@query("""WITH r AS (SELECT event_id, event_type, value, hour(ts) AS h, dayofyear(ts) AS d FROM events), day AS (SELECT event_type, h, d, sum(value) AS s, count(value) AS n FROM r GROUP BY ALL)
SELECT event_id, round(any_value(r.value) - sum(day.s) / sum(day.n), 6) + 0e0 AS anomaly FROM r JOIN day ON day.event_type = r.event_type AND day.h = r.h AND abs((r.d - day.d + 183 + 366) % 366 - 183) <= 7 GROUP BY event_id""")
def c8_climatology_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = rounded(series.climatology_anomaly(rows, ["event_type"], "ts", "value").select("event_id", "anomaly"), "anomaly")
    return out.withColumn("anomaly", F.col("anomaly") + F.lit(0.0))  # no negative zeros


@query(f"WITH {CLOSES}, r AS (SELECT day, x, (row_number() OVER (ORDER BY day) - 1) % 365 AS p FROM closes_a) SELECT day, round(x - CASE WHEN count(*) OVER (PARTITION BY p) > 1 THEN avg(x) OVER (PARTITION BY p) ELSE 0 END, 4) AS anomaly FROM r")
def c9_position_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = closes(spark, sf_dir)[0].withColumn("series_id", F.lit("a"))
    return rounded(series.position_anomaly(a, KEY, "day", "x").select("day", "anomaly"), "anomaly", digits=4)


@query(f"WITH {PAIRS}, c AS (SELECT DISTINCT series_id, n // 2 AS mid FROM pairs) SELECT series_id, t, x FROM pairs JOIN c USING (series_id) WHERE t >= (mid // 24 - 5) * 24 AND t < (mid // 24 + 5) * 24")
def c10_window_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    at = p.select("series_id", F.floor(F.col("n") / 2).alias("at")).distinct()
    return series.window_around(p, at, KEY, "t", 24, 5).select("series_id", "t", "x")


@query(f"WITH {CLOSES} SELECT day, 'both' AS kind FROM (SELECT day FROM closes_a INTERSECT SELECT day FROM closes_b) UNION ALL SELECT day, 'only b' FROM (SELECT day FROM closes_b EXCEPT SELECT day FROM closes_a)")
def c11_date_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.select("day") for x in closes(spark, sf_dir))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionAll(b.subtract(a).withColumn("kind", F.lit("only b")))


@query(f"WITH {CLOSES} SELECT day, coalesce(y, x) AS value FROM closes_a FULL JOIN closes_b USING (day)")
def c12_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = closes(spark, sf_dir)
    return a.join(b, "day", "full").select("day", F.coalesce("y", "x").alias("value"))


@query("SELECT vec_id, CAST(len(embedding) + 1 AS INTEGER) AS p, round(CAST(list_sum(list_append(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), 0.5e0)) AS DOUBLE), 6) AS total FROM embeddings")
def c13_upsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    out = series.upsampled(rows, "z", 0.5)
    return rounded(out.select("vec_id", F.size("z").alias("p"), F.aggregate("z", F.lit(0.0), lambda a, v: a + v).alias("total")), "total")


@query("SELECT event_id, round(round_even(value / 0.5e0, 0) * 0.5e0, 6) AS v FROM events")
def c14_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").select("event_id", series.half_even(F.col("value"), 0.5).alias("v")), "v")


@query("WITH v AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1), r AS (SELECT event_id, event_type, (CAST(json_extract(props, '$.k') AS BIGINT) % 100) / 1e2 AS p FROM events), a AS (SELECT event_id, v, p * (len(v) - 1) AS pos FROM r JOIN v USING (event_type)) SELECT event_id, round(v[CAST(floor(pos) AS INT) + 1] + (v[least(CAST(floor(pos) AS INT) + 2, len(v))] - v[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos)), 6) AS q FROM a")
def c15_quantile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = json_fields(table(spark, sf_dir, "events"), "props", "k long").withColumn("p", (F.col("k") % 100) / F.lit(100.0))
    return rounded(series.quantile_map(rows, ["event_type"], "value", "p", "q").select("event_id", "q"), "q")


@query(f"WITH {HOURLY}, w AS (SELECT series_id, t, list(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS w FROM hourly) SELECT series_id, t, CAST(list_sum(w) AS BIGINT) AS total FROM w WHERE len(w) = 24")
def c16_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.sliding(hourly(spark, sf_dir), KEY, "t", "y", 24)
    return out.select("series_id", "t", F.aggregate("window", F.lit(0.0), lambda a, v: a + v).cast("long").alias("total"))


@query(f"WITH {HOURLY} SELECT series_id, t, CAST(len(list_filter([100, 200, 400], lambda c: c <= t)) AS INTEGER) AS label FROM hourly")
def c17_segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.array(F.lit(100), F.lit(200), F.lit(400))
    return hourly(spark, sf_dir).select("series_id", "t", series.segment_label(F.col("t"), cuts).alias("label"))


# ---- joins (D)


@query(f"WITH {CLOSES}, j AS (SELECT day, x, y FROM closes_a JOIN closes_b USING (day)), d AS (SELECT day, ln(x) - lag(ln(x)) OVER (ORDER BY day) AS dx, ln(y) - lag(ln(y)) OVER (ORDER BY day) AS dy FROM j) SELECT day, round(dx, 9) AS dx, round(dy, 9) AS dy FROM d WHERE dx IS NOT NULL")
def d1_aligned_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.aligned_first(*closes(spark, sf_dir), "day", "x", "y"), "dx", "dy", digits=9)


@query(f"WITH {CLOSES}, a AS (SELECT day, ln(x) - lag(ln(x)) OVER (ORDER BY day) AS dx FROM closes_a), b AS (SELECT day, ln(y) - lag(ln(y)) OVER (ORDER BY day) AS dy FROM closes_b) SELECT day, round(dx, 9) AS dx, round(dy, 9) AS dy FROM a JOIN b USING (day) WHERE dx IS NOT NULL AND dy IS NOT NULL")
def d2_differenced_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.differenced_first(*closes(spark, sf_dir), "day", "x", "y"), "dx", "dy", digits=9)


@query(f"WITH {CLOSES} SELECT a.day, x, b.y AS previous FROM closes_a a ASOF LEFT JOIN closes_b b ON b.day < a.day")
def d3_asof_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = closes(spark, sf_dir)
    return series.latest_before(a, b, "day", "y", "previous")


@query(f"WITH {HOURLY} SELECT a.series_id, CAST(sum(abs(a.y - b.y)) AS BIGINT) AS total, count(*) AS n FROM hourly a JOIN hourly b USING (series_id) GROUP BY 1")
def d5_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.tiles import tiled

    rows = tiled(hourly(spark, sf_dir), "y", lambda i, v: {"far": (lambda m: np.bincount(i, m.sum(axis=1), len(v["y"])))(np.abs(v["y"][i, None] - v["y"]))}, ["far"])
    return rows.groupBy("series_id").agg(F.sum("far").cast("long").alias("total"), F.sum("n").cast("long").alias("n"))


@query(f"WITH {HOURLY} SELECT a.series_id, a.t, count(b.t) AS dominated FROM hourly a LEFT JOIN hourly b ON a.series_id = b.series_id AND b.x <= a.x AND b.y <= a.y GROUP BY ALL")
def d6_dominance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.scans import dominance_counts

    return dominance_counts(hourly(spark, sf_dir))


@query("SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'")
def d9_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def d10_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_acctbal")


@query("WITH a AS (SELECT event_type, user_id, event_id AS t FROM events WHERE event_id % 2 = 0), b AS (SELECT event_type, user_id, event_id AS t FROM events WHERE event_id % 2 = 1) SELECT a.event_type, a.user_id, a.t, b.t AS t_b FROM a JOIN b ON a.event_type = b.event_type AND a.user_id = b.user_id AND abs(a.t - b.t) <= 300")
def d11_proximity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.col("event_id").alias("t"))
    return series.near(e.filter("t % 2 = 0"), e.filter("t % 2 = 1"), ["event_type", "user_id"], "t", 300)


@query("WITH k AS (SELECT p_partkey, CAST(regexp_extract(p_name, '([0-9]+)', 1) AS VARCHAR) AS id, regexp_extract(p_name, '^([A-Za-z]+)', 1) AS word FROM part) SELECT word, count(*) AS n, count(l_partkey) AS used FROM k LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON l_partkey = p_partkey GROUP BY 1")
def d12_parsed_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_name", "^([A-Za-z]+)", 1).alias("word"))
    used = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return k.join(used, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("word").agg(F.count("*").alias("n"), F.count("l_partkey").alias("used"))


# ---- ranks and windows (E)


@query(f"WITH {PAIRS} SELECT series_id, t, round(row_number() OVER (PARTITION BY series_id ORDER BY x, t) / (n + 1e0), 9) AS x_u, round(row_number() OVER (PARTITION BY series_id ORDER BY y, t) / (n + 1e0), 9) AS y_u FROM pairs")
def e1_pseudo_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.pseudo_observations(pairs(spark, sf_dir), KEY, "t", ["x", "y"]).select("series_id", "t", "x_u", "y_u"), "x_u", "y_u", digits=9)


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS r FROM events")
def e2_two_level_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value", F.lit(0).alias("g"))
    splits = e.agg(F.percentile_approx("value", [k / 16 for k in range(1, 16)], 1000)).first()[0] or []
    return ordinal_ranks(e, ["g"], ["value", "event_id"], "r", sorted(set(splits))).select("event_id", "r")


@query(f"WITH {PAIRS} SELECT series_id, t, round((rank() OVER (PARTITION BY series_id ORDER BY y) + (count(*) OVER (PARTITION BY series_id, y) - 1) / 2e0) / (n + 1e0) - 0.5, 9) AS r FROM pairs")
def e3_average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.average_ranks(pairs(spark, sf_dir), KEY, "y", "r").select("series_id", "t", "r"), "r", digits=9)


@query()
def e4_jittered_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.jittered_ranks(pairs(spark, sf_dir), KEY, "t", "y", "r", 7).select("series_id", "t", "r")


@query(f"WITH {PAIRS}, s AS (SELECT *, CAST(t > 700 AS INTEGER) AS segment FROM pairs) SELECT series_id, t, segment, round(row_number() OVER (PARTITION BY series_id, segment ORDER BY x, t) / (count(*) OVER (PARTITION BY series_id, segment) + 1e0), 9) AS r FROM s")
def e5_segment_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.segment_ranks(pairs(spark, sf_dir), KEY, "t", "x", "r", 700).select("series_id", "t", "segment", "r"), "r", digits=9)


@query(f"""WITH {PAIRS}, c AS (SELECT series_id, t, n, avg(x) OVER l AS mx, avg(y) OVER l AS my, avg(x*x) OVER l AS xx, avg(x*y) OVER l AS xy, avg(y*y) OVER l AS yy FROM pairs WINDOW l AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT series_id, t, round(mx, 6) AS mx, round(xx - mx*mx, 6) AS vx, round(xy - mx*my, 5) AS cxy, round(xx / (xx + yy), 9) AS rho_xx, round(xy / (xx + yy), 9) AS rho_xy FROM c""")
def e7_segment_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.prefix import running_sums

    run = running_sums(pairs(spark, sf_dir), KEY, "t", {"sx": "x", "sy": "y", "sxx": "x*x", "sxy": "x*y", "syy": "y*y"})
    m = {k: F.col(f"s{k}") / F.col("t") for k in ("x", "y", "xx", "xy", "yy")}
    trace = m["xx"] + m["yy"]
    out = run.select("series_id", "t", m["x"].alias("mx"), (m["xx"] - m["x"] * m["x"]).alias("vx"), (m["xy"] - m["x"] * m["y"]).alias("cxy"), (m["xx"] / trace).alias("rho_xx"), (m["xy"] / trace).alias("rho_xy"))
    return rounded(rounded(rounded(out, "mx", "vx"), "cxy", digits=5), "rho_xx", "rho_xy", digits=9)


@query(f"WITH {HOURLY}, w AS (SELECT series_id, t, n, CASE WHEN var_pop(x) OVER k > 0 AND var_pop(y) OVER k > 0 THEN corr(x, y) OVER k END AS r, stddev_pop(x) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING) AS sd FROM hourly WINDOW k AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)) SELECT series_id, t, round(r, 6) AS trailing, round(sd, 3) AS spread FROM w WHERE t > 26")
def e9_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("t")
    out = hourly(spark, sf_dir).select("series_id", "t", ranks.correlation("x", "y", w.rowsBetween(-26, -1)).alias("trailing"), F.stddev_pop("x").over(w.rowsBetween(-26, 26)).alias("spread"))
    return rounded(rounded(out.filter("t > 26"), "trailing"), "spread", digits=3)


@query(f"WITH {PAIRS} SELECT series_id, t, x FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y, t) AS k FROM pairs) WHERE k <= 25")
def e11_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.bottom_k(pairs(spark, sf_dir), KEY, ["y", "t"], 25).select("series_id", "t", "x")


@query(f"WITH {HOURLY}, l AS (SELECT series_id, n, x, lag(x) OVER (PARTITION BY series_id ORDER BY t) AS b FROM hourly), r AS (SELECT series_id, max(n) AS n, corr(x, b) AS r FROM l WHERE b IS NOT NULL GROUP BY 1) SELECT series_id, round(r, 6) AS r1, round(n * (1 - r) / (1 + r), 4) AS ess FROM r")
def e12_effective_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.diagnose import effective_sample_size

    return rounded(rounded(effective_sample_size(hourly(spark, sf_dir), KEY, "t", "x"), "r1"), "ess", digits=4)


# ---- aggregates (F)


@query(f"WITH {PAIRS} SELECT series_id, CAST((t - 1) // 200 AS BIGINT) AS interval, count(*) AS cnt, round(sum(x*x), 4) AS mxx, round(sum(x*y), 4) AS mxy, CAST(sum(y*y) AS BIGINT) AS myy FROM pairs GROUP BY ALL")
def f1_interval_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pairs(spark, sf_dir).groupBy("series_id", F.floor((F.col("t") - 1) / 200).cast("long").alias("interval"))
    return rounded(out.agg(F.count("*").alias("cnt"), F.sum(F.expr("x*x")).alias("mxx"), F.sum(F.expr("x*y")).alias("mxy"), F.sum(F.expr("y*y")).cast("long").alias("myy")), "mxx", "mxy", digits=4)


@query("SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS q90, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, max(value) AS top FROM events GROUP BY 1")
def f3_f4_f5_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.percentile("value", F.lit(p))
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("median"), q(0.9).alias("q90"), (q(0.75) - q(0.25)).alias("iqr"), F.max("value").alias("top")), "median", "q90", "iqr")


@query("SELECT event_type, count(*) AS n, round(avg(CAST(value > 10 AS INT)), 9) AS rate, round(sqrt(avg(CAST(value > 10 AS INT)) * (1 - avg(CAST(value > 10 AS INT))) / count(*)), 9) AS se FROM events GROUP BY 1")
def f6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.evaluate import rate

    return rounded(rate(table(spark, sf_dir, "events").withColumn("hit", F.col("value") > 10), ["event_type"], "hit"), "rate", "se", digits=9)


@query(f"WITH {PAIRS} SELECT series_id, round(avg(CAST(k > 1 AS INT)), 9) AS tie_share FROM (SELECT series_id, count(*) OVER (PARTITION BY series_id, x) AS k FROM pairs) GROUP BY 1")
def f8_tie_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.tie_share(pairs(spark, sf_dir), KEY, "x"), "tie_share", digits=9)


@query("SELECT event_type, count(*) AS present, count(CASE WHEN value > 2 AND value < 50 THEN 1 END) AS used, count(CASE WHEN NOT (value > 2 AND value < 50) THEN 1 END) AS dropped, arg_max(user_id, (value, event_id)) AS worst_user FROM events GROUP BY 1")
def f9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = (F.col("value") > 2) & (F.col("value") < 50)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("present"), F.count_if(used).alias("used"), F.count_if(~used).alias("dropped"), F.max_by("user_id", F.struct("value", "event_id")).alias("worst_user"))


@query("""WITH b AS (SELECT o_orderstatus, year(o_orderdate) AS yr, quarter(o_orderdate) AS q, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 5), g AS (SELECT o_orderstatus, q, avg(v) AS gv FROM b GROUP BY ALL HAVING count(*) >= 2)
SELECT o_orderstatus, round(max(gv) / min(gv), 6) AS ratio FROM g GROUP BY 1 HAVING count(*) >= 2""")
def f10_block_variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumns({"yr": F.year("o_orderdate"), "q": F.quarter("o_orderdate")})
    b = rows.groupBy("o_orderstatus", "yr", "q").agg(F.var_pop("o_totalprice").alias("v"), F.count("*").alias("n")).filter("n >= 5")
    g = b.groupBy("o_orderstatus", "q").agg(F.avg("v").alias("gv"), F.count("*").alias("k")).filter("k >= 2")
    return rounded(g.groupBy("o_orderstatus").agg(F.try_divide(F.max("gv"), F.min("gv")).alias("ratio"), F.count("*").alias("k")).filter("k >= 2").drop("k"), "ratio")


_AVG = lambda c: f"rank() OVER (PARTITION BY yr ORDER BY {c}) + (count(*) OVER (PARTITION BY yr, {c}) - 1) / 2e0"


@query(f"""WITH {CLOSES}, j AS (SELECT year(CAST(day AS DATE)) AS yr, x, y FROM closes_a JOIN closes_b USING (day)), r AS (SELECT yr, x, {_AVG('x')} AS rx, {_AVG('y')} AS ry FROM j) SELECT yr, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(corr(rx, ry), 6) END AS spearman, round(stddev_samp(x) * sqrt(252), 2) AS annual_sd FROM r GROUP BY 1 HAVING count(*) > 50""")
def f11_yearly_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = closes(spark, sf_dir)
    j = a.join(b, "day").withColumn("yr", F.year("day").cast("long"))
    sd = j.groupBy("yr").agg((F.stddev_samp("x") * F.sqrt(F.lit(252.0))).alias("annual_sd"))
    return rounded(rounded(ranks.spearman(j, ["yr"], "x", "y").join(sd, "yr").filter("n > 50"), "spearman"), "annual_sd", digits=2)


@query("SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) GROUP BY 1")
def f12_histogram_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("users"))


@query("SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY ALL")
def f13_grouped_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n")), "mean", digits=4)


@query("WITH m AS (SELECT event_type, user_id % 3 AS mode, avg(value) AS p FROM events GROUP BY ALL) SELECT event_type, arg_max(mode, (round(p, 9), -mode)) AS best_mode, round(max(p), 6) AS best FROM m GROUP BY 1")
def f15_f17_best_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.evaluate import best_form

    m = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("mode")).agg(F.avg("value").alias("p"))
    return rounded(best_form(m, ["event_type"], "mode", "p"), "best")


@query("SELECT event_type, round(quantile_cont(user_id, 0.25), 6) AS q1, round(quantile_cont(user_id, 0.5), 6) AS q2, round(quantile_cont(user_id, 0.75), 6) AS q3, round(quantile_cont(CASE WHEN value > 10 THEN user_id END, 0.5), 6) AS q2_detected FROM events GROUP BY 1")
def f18_location_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p, c="user_id": F.percentile(c, F.lit(p))
    rows = table(spark, sf_dir, "events").withColumn("found", F.when(F.col("value") > 10, F.col("user_id")))
    return rounded(rows.groupBy("event_type").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), q(0.5, "found").alias("q2_detected")), "q1", "q2", "q3", "q2_detected")


@query("SELECT event_type, CASE WHEN count(CASE WHEN value > 45 THEN 1 END) > 0 THEN 'timeout' WHEN count(CASE WHEN value > 30 THEN 1 END) > 0 THEN 'memory' WHEN count(*) < 10 THEN 'not run' ELSE 'ok' END AS status FROM events GROUP BY 1")
def f19_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    status = F.when(F.count_if(v > 45) > 0, "timeout").when(F.count_if(v > 30) > 0, "memory").when(F.count("*") < 10, "not run").otherwise("ok")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(status.alias("status"))
