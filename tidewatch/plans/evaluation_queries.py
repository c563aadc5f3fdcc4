"""Queries: calibration after the curves (J), evaluation and multiplicity (M), end shares (N5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import evaluate
from tidewatch.operators.series import segment_label
from tidewatch.plans.fixtures import HOURLY, hourly, rounded, table
from tidewatch.plans.registry import query

#: Curves for calibration: users are replicas (0: observed), hours are positions, exact sums are the values.
CURVES = """curves AS (SELECT event_type AS series_id, user_id % 40 AS replica, hour(ts) + 24 * (day(ts) % 3) AS t, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS q FROM events GROUP BY ALL)"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), (F.col("user_id") % 40).alias("replica"), (F.hour(ts) + 24 * (F.dayofmonth(ts) % 3)).cast("long").alias("t"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return rows.groupBy("series_id", "replica", "t").agg(F.sum("c").cast("double").alias("q"))


KEY = ["series_id"]
_MAXIMA = f"""{CURVES}, z AS (SELECT *, (q - avg(q) OVER w) / (stddev_pop(q) OVER w + 1e-12) AS z FROM curves WINDOW w AS (PARTITION BY series_id, t)),
maxima AS (SELECT series_id, replica, max(z) AS t_max, arg_max(t, (round(z, 9), -t)) AS tau_hat FROM z GROUP BY ALL)"""


@query(f"WITH {CURVES} SELECT series_id, t, round(avg(q), 4) AS mu, round(stddev_pop(q), 4) AS sd, round(quantile_cont(q, 0.95), 4) AS q95 FROM curves GROUP BY ALL")
def f2_null_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves(spark, sf_dir).groupBy("series_id", "t").agg(F.avg("q").alias("mu"), F.stddev_pop("q").alias("sd"), F.percentile("q", F.lit(0.95)).alias("q95")), "mu", "sd", "q95", digits=4)


@query(f"WITH {_MAXIMA} SELECT series_id, replica, round(t_max, 6) AS t_max, tau_hat FROM maxima")
def j6_studentized_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.studentized_maxima(curves(spark, sf_dir), KEY), "t_max")


@query(f"WITH {_MAXIMA}, o AS (SELECT series_id, t_max AS observed, tau_hat AS tau FROM maxima WHERE replica = 0) SELECT series_id, round(observed, 6) AS observed, tau, round((1 + count(CASE WHEN t_max >= observed - 1e-9 * greatest(1, abs(observed)) THEN 1 END)) / (count(*) + 1e0), 9) AS p FROM maxima JOIN o USING (series_id) WHERE replica > 0 GROUP BY ALL")
def j9_permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(evaluate.permutation_p(evaluate.studentized_maxima(curves(spark, sf_dir), KEY), KEY), "observed"), "p", digits=9)


@query(f"WITH {CURVES}, m AS (SELECT series_id, t, avg(q) AS mu, stddev_pop(q) AS sd FROM curves WHERE replica > 0 GROUP BY ALL) SELECT series_id, t, round((q - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z FROM curves JOIN m USING (series_id, t) WHERE replica = 0")
def j7_null_studentized(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves(spark, sf_dir)
    m = c.filter("replica > 0").groupBy("series_id", "t").agg(F.avg("q").alias("mu"), F.stddev_pop("q").alias("sd"))
    z = (F.col("q") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return rounded(c.filter("replica = 0").join(m, ["series_id", "t"]).select("series_id", "t", z.alias("z")), "z")


@query("SELECT event_id, value >= (user_id / 3e0) - 1e-9 * greatest(1, abs(user_id / 3e0)) AS ge FROM events")
def j8_tolerant_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", evaluate.reaches(F.col("value"), F.col("user_id") / F.lit(3.0)).alias("ge"))


@query(f"WITH {_MAXIMA}, o AS (SELECT series_id, t_max AS observed FROM maxima WHERE replica = 0), r AS (SELECT series_id, quantile_cont(t_max, 0.95) AS threshold FROM maxima WHERE replica > 0 GROUP BY 1) SELECT series_id, round(observed, 6) AS observed, round(threshold, 6) AS threshold, observed > threshold AS rejects FROM o JOIN r USING (series_id)")
def j10_quantile_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.quantile_decision(evaluate.studentized_maxima(curves(spark, sf_dir), KEY), KEY, 0.05), "observed", "threshold")


_NULLS = f"""{CURVES}, raw AS (SELECT series_id, quantile_cont(m, 0.95) AS raw FROM (SELECT series_id, replica, max(q) AS m FROM curves GROUP BY ALL) GROUP BY 1),
reps AS (SELECT series_id, count(DISTINCT replica) // 2 AS half FROM curves GROUP BY 1),
mom AS (SELECT series_id, t, avg(q) AS mu, stddev_pop(q) AS sd FROM curves JOIN reps USING (series_id) WHERE replica < half GROUP BY ALL),
std AS (SELECT series_id, quantile_cont(m, 0.95) AS studentized FROM (SELECT series_id, replica, max((q - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END) AS m FROM curves JOIN mom USING (series_id, t) JOIN reps USING (series_id) WHERE replica >= half GROUP BY ALL) GROUP BY 1)"""


@query(f"WITH {_NULLS} SELECT series_id, round(raw, 4) AS raw, round(studentized, 6) AS studentized FROM raw JOIN std USING (series_id)")
def j13_mc_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(evaluate.null_thresholds(curves(spark, sf_dir).withColumnRenamed("replica", "rep"), KEY, 0.05), "raw", digits=4), "studentized")


_VERDICTS = f"""{CURVES}, top AS (SELECT series_id, replica, max(q) AS max, arg_max(t, (round(q, 9), -t)) AS tau_hat FROM curves GROUP BY ALL), h AS (SELECT series_id, quantile_cont(max, 0.5) AS threshold FROM top GROUP BY 1),
v AS (SELECT series_id, replica, max, tau_hat, threshold, max > threshold AS detected, max > threshold AND abs(tau_hat - 36) <= 12 AS power_hit, CASE WHEN max > threshold THEN abs(tau_hat - 36) END AS loc_err FROM top JOIN h USING (series_id))"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves(spark, sf_dir)
    h = c.groupBy("series_id", "replica").agg(F.max("q").alias("m")).groupBy("series_id").agg(F.percentile("m", F.lit(0.5)).alias("threshold"))
    return evaluate.verdicts(c, ["series_id", "replica"], h, KEY, 36, 12)


@query(f"WITH {_VERDICTS} SELECT * FROM v")
def m1_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query(f"WITH {_VERDICTS} SELECT series_id, round(avg(CAST(power_hit AS INT)), 9) AS power, round(avg(CAST(detected AS INT)), 9) AS detect_rate, median(loc_err) AS loc_err_median, count(*) AS n_reps FROM v GROUP BY 1")
def m2_power_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.power_summary(_verdicts(spark, sf_dir), KEY), "power", "detect_rate", digits=9)


_CUTS = "c AS (SELECT o_custkey, list_sort(list(DISTINCT CAST(o_orderkey % 100 AS INTEGER)) FILTER (o_orderstatus = 'F')) AS tr, list_sort(list(DISTINCT CAST(o_orderkey % 100 AS INTEGER)) FILTER (o_orderstatus = 'O')) AS es FROM orders GROUP BY 1), k AS (SELECT o_custkey, coalesce(tr, []) AS tr, coalesce(es, []) AS es FROM c)"


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("o_orderkey") % 100).cast("int")
    one = lambda s: F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == s, at)))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(one("F").alias("tr"), one("O").alias("es")).withColumn("n", F.lit(100))


@query(f"WITH {_CUTS} SELECT o_custkey, CAST(CASE WHEN len(tr) = 0 AND len(es) = 0 THEN 0 WHEN len(tr) = 0 OR len(es) = 0 THEN 100 ELSE greatest(list_max(list_transform(tr, lambda x: list_min(list_transform(es, lambda y: abs(x - y))))), list_max(list_transform(es, lambda x: list_min(list_transform(tr, lambda y: abs(x - y)))))) END AS DOUBLE) AS hausdorff FROM k")
def m3_hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.hausdorff(_cuts(spark, sf_dir), "tr", "es", "n").select("o_custkey", "hausdorff")


@query(f"""WITH {HOURLY}, l AS (SELECT series_id, len(list_filter([100, 300], lambda c: c <= t)) AS a, len(list_filter([120, 250, 400], lambda c: c <= t)) AS b FROM hourly), ab AS (SELECT series_id, sum(n * (n - 1) / 2e0) AS sij FROM (SELECT series_id, count(*) AS n FROM l GROUP BY series_id, a, b) GROUP BY 1),
a AS (SELECT series_id, sum(n * (n - 1) / 2e0) AS si, sum(n) AS m FROM (SELECT series_id, count(*) AS n FROM l GROUP BY series_id, a) GROUP BY 1), b AS (SELECT series_id, sum(n * (n - 1) / 2e0) AS sj FROM (SELECT series_id, count(*) AS n FROM l GROUP BY series_id, b) GROUP BY 1),
e AS (SELECT *, si * sj / (m * (m - 1) / 2e0) AS ex, (si + sj) / 2 AS mx FROM ab JOIN a USING (series_id) JOIN b USING (series_id)) SELECT series_id, round(CASE WHEN mx <> ex THEN (sij - ex) / (mx - ex) ELSE 1 END, 9) AS ari FROM e""")
def m4_adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda *c: segment_label(F.col("t"), F.array(*map(F.lit, c)))
    return rounded(evaluate.adjusted_rand(hourly(spark, sf_dir).select("series_id", cut(100, 300).alias("a"), cut(120, 250, 400).alias("b")), KEY, "a", "b"), "ari", digits=9)


@query(f"WITH {_CUTS}, h AS (SELECT o_custkey, len(tr) AS nt, len(es) AS ne, len(list_filter(tr, lambda x: len(list_filter(es, lambda y: abs(x - y) <= 10)) > 0)) AS ht, len(list_filter(es, lambda x: len(list_filter(tr, lambda y: abs(x - y) <= 10)) > 0)) AS he FROM k) SELECT o_custkey, round(CASE WHEN nt > 0 THEN ht / nt END, 9) AS recall, round(CASE WHEN ne > 0 THEN he / ne END, 9) AS precision, nt = ne AND ht = nt AS exact FROM h")
def m5_recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.recall_precision(_cuts(spark, sf_dir), "tr", "es", 10).select("o_custkey", "recall", "precision", "exact"), "recall", "precision", digits=9)


#: p-values of a family per order status: ranks of prices, distinct by construction.
_P = "pv AS (SELECT o_orderstatus AS family, o_orderkey AS id, pow(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) / (count(*) OVER (PARTITION BY o_orderstatus) + 1e0), 6) AS p FROM orders), pk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS m FROM pv)"


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey"))
    share = rank / (F.count("*").over(Window.partitionBy("o_orderstatus")) + F.lit(1.0))
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("family"), F.col("o_orderkey").alias("id"), F.pow(share, 6).alias("p"))


@query(f"WITH {_P} SELECT family, id, round(least(1, min(p * m / k) OVER w), 9) AS bh, round(least(1, min(p * m * h / k) OVER w), 9) AS q_by FROM pk JOIN (SELECT family, list_sum(list_transform(range(1, max(m) + 1), lambda i: 1e0 / i)) AS h FROM pk GROUP BY 1) USING (family) WINDOW w AS (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def m6_step_up_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _p_values(spark, sf_dir)
    out = evaluate.step_up_q(evaluate.step_up_q(p, ["family"], "p", "bh"), ["family"], "p", "q_by", True)
    return rounded(out.select("family", "id", "bh", "q_by"), "bh", "q_by", digits=9)


@query(f"WITH {_P} SELECT family, id, round(max(least(1, (m - k + 1) * p)) OVER (PARTITION BY family ORDER BY k ROWS UNBOUNDED PRECEDING), 9) AS holm FROM pk")
def m7_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.holm(_p_values(spark, sf_dir), ["family"], "p", "holm").select("family", "id", "holm"), "holm", digits=9)


@query("""WITH d AS (SELECT user_id, count(CASE WHEN value > 60 AND event_id % 2 = 0 THEN 1 END) AS b, count(CASE WHEN value > 60 AND event_id % 2 = 1 THEN 1 END) AS c FROM events GROUP BY 1)
SELECT user_id, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1)))) / pow(2e0, b + c)) END, 6) AS p FROM d""")
def m8_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("value") > 60
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(big & (F.col("event_id") % 2 == 0)).alias("b"), F.count_if(big & (F.col("event_id") % 2 == 1)).alias("c"))
    return rounded(d.withColumn("p", evaluate.mcnemar_exact(F.col("b"), F.col("c"))), "p")


@query("""WITH e AS (SELECT event_type, event_id % 2 AS g, value FROM events), p AS (SELECT a.event_type, a.value, (SELECT count(*) FROM e b WHERE b.event_type = a.event_type AND g = 0 AND b.value <= a.value) AS ca, (SELECT count(*) FROM e b WHERE b.event_type = a.event_type AND g = 1 AND b.value <= a.value) AS cb FROM (SELECT DISTINCT event_type, value FROM e) a),
n AS (SELECT event_type, count(CASE WHEN g = 0 THEN 1 END) AS n0, count(CASE WHEN g = 1 THEN 1 END) AS n1 FROM e GROUP BY 1) SELECT event_type, round(max(abs(ca / (n0 * 1e0) - cb / (n1 * 1e0))), 9) AS ks FROM p JOIN n USING (event_type) GROUP BY 1""")
def m10_ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("g", F.col("event_id") % 2)
    return rounded(evaluate.ks_two_sample(e, ["event_type"], "g", "value"), "ks", digits=9)


@query("SELECT event_id, CASE WHEN value <= 20 AND user_id > 50 THEN 'dependence change' WHEN value <= 20 THEN 'both change' WHEN user_id <= 50 THEN 'marginal change' ELSE 'no change' END AS cls FROM events")
def m11_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("u", F.col("user_id").cast("double"))
    return evaluate.classified(e, "value", "u", ("dependence change", "both change", "marginal change", "no change"), 20.0, 50.0).select("event_id", "cls")


@query(f"WITH {CURVES} SELECT series_id, round(quantile_cont(q, CAST(1 - 0.05 / 5 AS DOUBLE)), 4) AS threshold FROM curves WHERE replica > 0 GROUP BY 1")
def m12_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.bonferroni_threshold(curves(spark, sf_dir).filter("replica > 0"), KEY, 5, 0.05), "threshold", digits=4)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, " + ", ".join(f"round(quantile_cont(value, CAST({p} AS DOUBLE)), 6) AS q{round(100 * p):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM events GROUP BY 1")
def m14_distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.distribution_summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return rounded(out, *[c for c in out.columns if c != "event_type"])


@query("SELECT event_type, round(avg(CAST(user_id / 150e0 <= 0.115 OR user_id / 150e0 >= 0.885 AS INT)), 9) AS end_share, count(*) AS n FROM events GROUP BY 1")
def n5_end_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("user_id") / F.lit(150.0)
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(((at <= 0.115) | (at >= 0.885)).cast("double")).alias("end_share"), F.count("*").alias("n")), "end_share", digits=9)


@query("""WITH r AS (SELECT event_type AS scen, user_id % 2 AS level, value > 20 AS detected, value > 20 AND value < 60 AS localized FROM events), g AS (SELECT scen, level, avg(CAST(localized AS INT)) AS rate FROM r GROUP BY ALL)
SELECT scen, level, round(g.rate, 9) AS localized, round(avg(CAST(detected AS INT)), 9) AS rejected FROM r JOIN g USING (scen, level) GROUP BY ALL""")
def f16_rejection_and_localized_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The localized rate as stored in an aggregate, the rejection rate made again from the records."""
    r = table(spark, sf_dir, "events").select(F.col("event_type").alias("scen"), (F.col("user_id") % 2).alias("level"), (F.col("value") > 20).alias("detected"), ((F.col("value") > 20) & (F.col("value") < 60)).alias("localized"))
    stored = evaluate.rate(r, ["scen", "level"], "localized").select("scen", "level", F.col("rate").alias("localized"))
    again = evaluate.rate(r, ["scen", "level"], "detected").select("scen", "level", F.col("rate").alias("rejected"))
    return rounded(stored.join(again, ["scen", "level"]), "localized", "rejected", digits=9)


@query("SELECT o_custkey, count(*) AS orders FROM orders WHERE o_orderdate < DATE '2001-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01') GROUP BY 1")
def b3_unfinished_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.sources.writers import unfinished

    o = table(spark, sf_dir, "orders")
    cut = F.to_date(F.lit("2001-01-01"))
    return unfinished(o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut), ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("orders"))
