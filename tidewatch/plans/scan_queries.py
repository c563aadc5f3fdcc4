"""Queries: change statistics over the split (I), all checked in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import scans
from tidewatch.plans.fixtures import HOURLY, PAIRS, hourly, pairs, rounded
from tidewatch.plans.registry import query

W, W_SHORT = 60, 60
#: Frequencies and phases of the cosine features, fixed values.
FEATURES = ((1.3, -2.1, 3.7, 0.6), (0.4, 2.2, 5.1, 3.3), (-1.7, 2.9, 0.8, -3.2), (1.1, 4.4, 0.2, 2.7))


def scan(df: DataFrame) -> DataFrame:
    return rounded(df.select("series_id", "t", "q"), "q")


_RANKED = """
ranked AS (
  SELECT series_id, t, n, 2 * row_number() OVER (PARTITION BY series_id ORDER BY x, t) - n - 1 AS a, 2 * row_number() OVER (PARTITION BY series_id ORDER BY y, t) - n - 1 AS b
  FROM {source}
)"""
_SPEARMAN = f"""
run AS (
  SELECT series_id, t, n, CAST(sum(a) OVER l AS DOUBLE) AS sa, CAST(sum(b) OVER l AS DOUBLE) AS sb, CAST(sum(a*a) OVER l AS DOUBLE) AS saa, CAST(sum(b*b) OVER l AS DOUBLE) AS sbb, CAST(sum(a*b) OVER l AS DOUBLE) AS sab,
    CAST(coalesce(sum(a) OVER r, 0) AS DOUBLE) AS ra, CAST(coalesce(sum(b) OVER r, 0) AS DOUBLE) AS rb, CAST(coalesce(sum(a*a) OVER r, 0) AS DOUBLE) AS raa, CAST(coalesce(sum(b*b) OVER r, 0) AS DOUBLE) AS rbb, CAST(coalesce(sum(a*b) OVER r, 0) AS DOUBLE) AS rab,
    CAST(t AS DOUBLE) AS m, CAST(n - t AS DOUBLE) AS r, 4 * pow(CAST(n AS DOUBLE) + 1, 2) AS u
  FROM ranked
  WINDOW l AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), curve AS (
  SELECT series_id, t, sqrt(m * r / n) * abs(
    ((sab/m - sa*sb/m/m)/u) / sqrt((saa/m - sa*sa/m/m)/u * ((sbb/m - sb*sb/m/m)/u) + 1e-12)
    - ((rab/r - ra*rb/r/r)/u) / sqrt((raa/r - ra*ra/r/r)/u * ((rbb/r - rb*rb/r/r)/u) + 1e-12)) AS q
  FROM run WHERE t BETWEEN {W} AND n - {W}
)"""


@query(f"WITH {PAIRS}, {_RANKED.format(source='pairs')}, {_SPEARMAN} SELECT series_id, t, round(q, 6) AS q FROM curve")
def i9_spearman_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.spearman_scan(pairs(spark, sf_dir), W))


@query(f"WITH {PAIRS}, {_RANKED.format(source='pairs')}, {_SPEARMAN} SELECT series_id, t, round(q, 6) AS q FROM curve")
def e6_two_level_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.spearman_scan(pairs(spark, sf_dir), W, block=2048))


@query(f"WITH {PAIRS}, {_RANKED.format(source='pairs')}, {_SPEARMAN} SELECT series_id, round(max(q), 6) AS q_max, arg_max(t, (round(q, 9), -t)) AS tau_hat FROM curve GROUP BY 1")
def e10_arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scans.arg_max(scans.spearman_scan(pairs(spark, sf_dir), W)), "q_max")


_SIDES = """
sides AS (
  SELECT series_id, t, n, CAST(n AS DOUBLE) AS nn, CAST(t AS DOUBLE) AS m, CAST(n - t AS DOUBLE) AS r,
    avg(x) OVER l AS lx, avg(y) OVER l AS ly, avg(x*x) OVER l AS lxx, avg(y*y) OVER l AS lyy, avg(x*y) OVER l AS lxy,
    avg(x) OVER g AS rx, avg(y) OVER g AS ry, avg(x*x) OVER g AS rxx, avg(y*y) OVER g AS ryy, avg(x*y) OVER g AS rxy,
    avg(x) OVER a AS ax, avg(y) OVER a AS ay, avg(x*x) OVER a AS axx, avg(y*y) OVER a AS ayy, avg(x*y) OVER a AS axy
  FROM {source}
  WINDOW a AS (PARTITION BY series_id), l AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
)"""


def _logdet(p: str) -> str:
    vx, vy, c = f"({p}xx - {p}x*{p}x)", f"({p}yy - {p}y*{p}y)", f"({p}xy - {p}x*{p}y)"
    root, add = f"sqrt(greatest(pow({vx} - {vy}, 2) + 4*{c}*{c}, 0))", f"1e-3 * greatest({vx} + {vy}, 1e-12) / 2"
    return f"(ln(greatest(({vx} + {vy} + {root}) / 2, 0) + {add}) + ln(greatest(({vx} + {vy} - {root}) / 2, 0) + {add}))"


@query(f"WITH {PAIRS}, {_SIDES.format(source='pairs')} SELECT series_id, t, round(nn * {_logdet('a')} - m * {_logdet('l')} - r * {_logdet('r')}, 5) AS q FROM sides WHERE t BETWEEN {W} AND n - {W}")
def i13_gauss_lr_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scans.gauss_lr_scan(pairs(spark, sf_dir), W), "q", digits=5)


@query(f"""WITH {PAIRS}, z AS (
  SELECT series_id, t, n, (x - avg(x) OVER s) / stddev_pop(x) OVER s AS x, (y - avg(y) OVER s) / stddev_pop(y) OVER s AS y FROM pairs WINDOW s AS (PARTITION BY series_id)
), c AS (
  SELECT series_id, t, n, sum(x*y) OVER l / sqrt(sum(x*x) OVER l * sum(y*y) OVER l) AS r, sum(x*y) OVER s / sqrt(sum(x*x) OVER s * sum(y*y) OVER s) AS r_all
  FROM z WINDOW s AS (PARTITION BY series_id), l AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)
) SELECT series_id, t, round(t / sqrt(n) * abs(r - r_all), 6) AS q FROM c WHERE t BETWEEN {W} AND n - {W}""")
def i18_corr_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.corr_cusum(pairs(spark, sf_dir), W))


UNIT = 50


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.floor((F.col("t") - 1) / UNIT) + 1
    sums = pairs(spark, sf_dir).groupBy("series_id", unit.cast("long").alias("t")).agg(F.sum("x").alias("s1"), F.sum(F.expr("x * x")).alias("s2"), F.count("*").alias("cnt"), F.ceil(F.max("n") / UNIT).cast("long").alias("n"))
    return sums


@query(f"""WITH {PAIRS}, i AS (SELECT series_id, (t - 1) // {UNIT} + 1 AS t, sum(x) AS s1, sum(x*x) AS s2, count(*) AS cnt FROM pairs GROUP BY ALL), c AS (
  SELECT series_id, t, count(*) OVER s AS b, CAST(sum(cnt) OVER l AS DOUBLE) AS nl, CAST(sum(cnt) OVER s - sum(cnt) OVER l AS DOUBLE) AS nr, sum(s1) OVER l AS l1, sum(s2) OVER l AS l2, sum(s1) OVER s - sum(s1) OVER l AS r1, sum(s2) OVER s - sum(s2) OVER l AS r2
  FROM i WINDOW s AS (PARTITION BY series_id), l AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING)
) SELECT series_id, CAST(t AS BIGINT) AS t, round(sqrt(nl * nr / (nl + nr)) * abs(ln(greatest(l2/nl - pow(l1/nl, 2), 1e-12)) - ln(greatest(r2/nr - pow(r1/nr, 2), 1e-12))) / 2, 6) AS q FROM c WHERE t BETWEEN 3 AND b - 3""")
def i21_marginal_scale_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.scale_scan(intervals(spark, sf_dir)))


@query(f"""WITH {PAIRS}, {_SIDES.format(source='pairs')} SELECT series_id, t, round(abs(lx - rx) / (sqrt((m * (lxx - lx*lx) + r * (rxx - rx*rx)) / (nn - 2)) * sqrt(1/m + 1/r)), 6) AS q FROM sides WHERE t BETWEEN 25 AND n - 25""")
def i23_bg_tstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.bg_tstat(pairs(spark, sf_dir)))


# ---- pair statistics, on hourly sums (at most 24 positions a day), every series and every hour
_UNITS = "units AS (SELECT series_id, t, n, row_number() OVER (PARTITION BY series_id ORDER BY x, t) / (n + 1e0) AS x, row_number() OVER (PARTITION BY series_id ORDER BY y, t) / (n + 1e0) AS y FROM hourly)"


def _pairs_sql(source: str) -> str:
    return f"p AS (SELECT i.series_id, i.n, i.t AS i, j.t AS j, i.x AS xi, j.x AS xj, i.y AS yi, j.y AS yj FROM {source} i JOIN {source} j USING (series_id))"


def _square_sums(names: list[str]) -> str:
    """Sums over the left square, the right square and the whole, from pairs by their larger and their smaller index."""
    both = ", ".join(f"sum({c}) AS {c}" for c in names)
    run = ", ".join(f"sum(u.{c}) OVER l AS {c}_l, coalesce(sum(d.{c}) OVER r, 0) AS {c}_r, sum(u.{c}) OVER s AS {c}_a" for c in names)
    return f"""up AS (SELECT series_id, n, greatest(i, j) AS t, {both} FROM k GROUP BY ALL), down AS (SELECT series_id, least(i, j) AS t, {both} FROM k GROUP BY ALL),
s AS (SELECT * FROM (SELECT u.series_id, u.n, u.t, CAST(u.t AS DOUBLE) AS m, CAST(u.n - u.t AS DOUBLE) AS r, {run} FROM up u JOIN down d USING (series_id, t)
  WINDOW l AS (PARTITION BY u.series_id ORDER BY u.t ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY u.series_id ORDER BY u.t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), s AS (PARTITION BY u.series_id)) WHERE t BETWEEN {W_SHORT} AND n - {W_SHORT})"""


@query(f"""WITH {HOURLY}, {_UNITS}, {_pairs_sql('units')}, med AS (SELECT series_id, quantile_cont(pow(xi - xj, 2), 0.5) AS mx, quantile_cont(pow(yi - yj, 2), 0.5) AS my FROM p WHERE i < j GROUP BY 1),
k AS (SELECT *, kx * ky AS kxy FROM (SELECT p.*, exp(-2 * pow(xi - xj, 2) / mx) AS kx, exp(-2 * pow(yi - yj, 2) / my) AS ky FROM p JOIN med USING (series_id))), {_square_sums(['kx', 'ky', 'kxy'])}
SELECT series_id, t, round(sqrt(m * r / n) * abs(ln(kxy_l * m * m / (kx_l * ky_l)) - ln(kxy_r * r * r / (kx_r * ky_r))), 6) AS q FROM s""")
def i17_gram_order2_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.gram_order2_scan(hourly(spark, sf_dir), W_SHORT))


@query(f"""WITH {HOURLY}, {_pairs_sql('hourly')}, med AS (SELECT series_id, quantile_cont(pow(xi - xj, 2) + pow(yi - yj, 2), 0.5) AS md FROM p WHERE i < j GROUP BY 1),
k AS (SELECT p.*, exp(-(pow(xi - xj, 2) + pow(yi - yj, 2)) / md) AS k FROM p JOIN med USING (series_id)), {_square_sums(['k'])}
SELECT series_id, t, round(m * r / n * greatest(k_l / (m*m) + k_r / (r*r) - (k_a - k_l - k_r) / (m*r), 0), 6) AS q FROM s""")
def i14_mmd_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.mmd_scan(hourly(spark, sf_dir), W_SHORT))


def _row_products(a: str, b: str, name: str) -> str:
    """At each t the sums over rows of products of their sums within the left, and within the right square."""
    return f"""{name} AS (SELECT series_id, j AS t, sum(CASE WHEN i <= j THEN ra * rb ELSE 0 END) AS l, sum(CASE WHEN i > j THEN (ta - ra) * (tb - rb) ELSE 0 END) AS r FROM (
  SELECT series_id, i, j, sum({a}) OVER o AS ra, sum({b}) OVER o AS rb, sum({a}) OVER e AS ta, sum({b}) OVER e AS tb FROM k WINDOW o AS (PARTITION BY series_id, i ORDER BY j), e AS (PARTITION BY series_id, i)) GROUP BY ALL)"""


@query(f"""WITH {HOURLY}, {_UNITS}, {_pairs_sql('units')}, med AS (SELECT series_id, quantile_cont(abs(xi - xj), 0.5) AS mx, quantile_cont(abs(yi - yj), 0.5) AS my FROM p WHERE i < j GROUP BY 1),
k AS (SELECT *, kx * ky AS kxy FROM (SELECT p.*, exp(-pow(xi - xj, 2) / (2 * mx * mx)) AS kx, exp(-pow(yi - yj, 2) / (2 * my * my)) AS ky FROM p JOIN med USING (series_id))), {_square_sums(['kx', 'ky', 'kxy'])}, {_row_products('kx', 'ky', 'w')}
SELECT series_id, t, round(abs((kxy_l - 2 * w.l / m + kx_l * ky_l / (m*m)) / (m*m) - (kxy_r - 2 * w.r / s.r + kx_r * ky_r / (s.r*s.r)) / (s.r*s.r)), 6) AS q FROM s JOIN w USING (series_id, t)""")
def i8_hsic_gram_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.hsic_gram_scan(hourly(spark, sf_dir), W_SHORT))


def _cov(c: str, side: str, m: str) -> str:
    return f"({c}_{side} / ({m}*{m}) - 2 * w{c}.{side} / ({m}*{m}*{m}) + {c[0]}_{side} * {c[1]}_{side} / ({m}*{m}*{m}*{m}))"


def _dcor(side: str, m: str) -> str:
    return f"sqrt(greatest({_cov('ab', side, m)}, 0) / sqrt({_cov('aa', side, m)} * {_cov('bb', side, m)} + 1e-18))"


@query(f"""WITH {HOURLY}, {_UNITS}, {_pairs_sql('units')}, k AS (SELECT *, a * b AS ab, a * a AS aa, b * b AS bb FROM (SELECT p.*, abs(xi - xj) AS a, abs(yi - yj) AS b FROM p)), {_square_sums(['a', 'b', 'ab', 'aa', 'bb'])},
{_row_products('a', 'b', 'wab')}, {_row_products('a', 'a', 'waa')}, {_row_products('b', 'b', 'wbb')}
SELECT series_id, t, round(sqrt(m * s.r / n) * abs({_dcor('l', 'm')} - {_dcor('r', 's.r')}), 6) AS q FROM s JOIN wab USING (series_id, t) JOIN waa USING (series_id, t) JOIN wbb USING (series_id, t)""")
def i12_dcor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.dcor_scan(hourly(spark, sf_dir), W_SHORT))


@query(f"""WITH {HOURLY}, {_UNITS}, p AS (SELECT i.series_id, i.n, i.t AS i, j.t AS j, CAST(i.x <= j.x AND i.y <= j.y AS BIGINT) AS hit FROM units i JOIN units j USING (series_id)),
c AS (SELECT series_id, n, i AS t, CAST(sum(hit) OVER (PARTITION BY series_id, j ORDER BY i) AS DOUBLE) AS c, CAST(sum(hit) OVER (PARTITION BY series_id, j) AS DOUBLE) AS e FROM p)
SELECT series_id, t, round(t * (n - t) / CAST(n AS DOUBLE) * avg(pow(c / t - (e - c) / (n - t), 2)), 6) AS q FROM c WHERE t BETWEEN {W_SHORT} AND n - {W_SHORT} GROUP BY series_id, t, n""")
def i10_copula_cvm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.copula_cvm_scan(hourly(spark, sf_dir), W_SHORT))


#: the splits at shares 0.1, 0.105, ... 0.9 of a series, each rounded to the nearest whole number (halves to the even one)
_SHARES = "v AS (SELECT DISTINCT series_id, n, CAST(round_even(n * (20 + s) * 5 / 1000e0, 0) AS BIGINT) AS k FROM (SELECT DISTINCT series_id, n FROM hourly), range(0, 161) AS r(s))"


@query(f"""WITH {HOURLY}, {_SHARES}, g AS (SELECT series_id, t, n, row_number() OVER (PARTITION BY series_id ORDER BY x, t) AS gx, row_number() OVER (PARTITION BY series_id ORDER BY y, t) AS gy FROM hourly),
c AS (SELECT g.*, k, t > k AS side FROM g JOIN v USING (series_id, n) WHERE k BETWEEN 2 AND n - 2),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, k, side ORDER BY gx) AS rx, row_number() OVER (PARTITION BY series_id, k, side ORDER BY gy) AS ry, count(*) OVER (PARTITION BY series_id, k, side) AS m FROM c),
e AS (SELECT r.series_id, r.k, r.n, p.gx, sum(CASE WHEN side THEN -1e0 / m ELSE 1e0 / m END * CAST(rx * r.n <= p.gx * m AND ry * r.n <= p.gy * m AS INT)) AS e FROM r JOIN g p USING (series_id) GROUP BY ALL)
SELECT series_id, CAST(k AS BIGINT) AS t, round(pow(k * (n - k) / pow(n, 1.5), 2) * avg(e * e), 6) AS q FROM e GROUP BY series_id, k, n""")
def i11_copula_cvm_subsample_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.copula_cvm_subsample_scan(hourly(spark, sf_dir)))


def _unit(col: str, ws: tuple, bs: tuple, name: str) -> str:
    raw = [f"sqrt(2e0/{len(ws)}) * cos({col} * ({a}) + {b})" for a, b in zip(ws, bs)]
    norm = "sqrt(" + " + ".join(f"pow({e}, 2)" for e in raw) + ")"
    return ", ".join(f"{e} / {norm} AS {name}{k}" for k, e in enumerate(raw))


_FEATURED = f"""{PAIRS}, units AS (SELECT series_id, t, n, row_number() OVER (PARTITION BY series_id ORDER BY x, t) / (n + 1e0) AS x, row_number() OVER (PARTITION BY series_id ORDER BY y, t) / (n + 1e0) AS y FROM pairs),
f AS (SELECT series_id, t, n, {_unit('x', FEATURES[0], FEATURES[1], 'f')}, {_unit('y', FEATURES[2], FEATURES[3], 'g')} FROM units)"""
_WINDOWS = "WINDOW l AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_HS = lambda p: " + ".join(f"pow(avg(f{a}*g{b}) OVER {p} - avg(f{a}) OVER {p} * avg(g{b}) OVER {p}, 2)" for a in range(4) for b in range(4))
_FR = " + ".join(f"pow(avg(f{a}*f{b}) OVER l - avg(f{a}*f{b}) OVER r, 2)" for a in range(4) for b in range(4))


@query(f"WITH {_FEATURED} SELECT * FROM (SELECT series_id, t, round(sqrt(t * (n - t) / CAST(n AS DOUBLE)) * abs(({_HS('l')}) - ({_HS('r')})), 6) AS q FROM f {_WINDOWS} QUALIFY t BETWEEN {W} AND n - {W})")
def i7_hsic_feature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.feature_scan(pairs(spark, sf_dir), FEATURES, W, "hsic"))


@query(f"WITH {_FEATURED} SELECT * FROM (SELECT series_id, t, round(sqrt(t * (n - t) / CAST(n AS DOUBLE)) * sqrt({_FR}), 6) AS q FROM f {_WINDOWS} QUALIFY t BETWEEN {W} AND n - {W})")
def i15_kernel_frobenius_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.feature_scan(pairs(spark, sf_dir), FEATURES, W, "frobenius"))


THREE = tuple(f[:3] for f in FEATURES)
_F3 = f"""{PAIRS}, units AS (SELECT series_id, t, n, row_number() OVER (PARTITION BY series_id ORDER BY x, t) / (n + 1e0) AS x, row_number() OVER (PARTITION BY series_id ORDER BY y, t) / (n + 1e0) AS y FROM pairs),
f AS (SELECT series_id, t, n, {_unit('x', THREE[0], THREE[1], 'f')}, {_unit('y', THREE[2], THREE[3], 'g')} FROM units)"""


def _purity(p: str) -> str:
    r = range(3)
    x = " + ".join(f"pow(avg(f{a}*f{b}) OVER {p}, 2)" for a in r for b in r)
    y = " + ".join(f"pow(avg(g{a}*g{b}) OVER {p}, 2)" for a in r for b in r)
    j = " + ".join(f"pow(avg(f{a}*f{b}*g{c}*g{e}) OVER {p}, 2)" for a in r for b in r for c in r for e in r)
    return f"ln({j}) - ln({x}) - ln({y})"


@query(f"WITH {_F3} SELECT * FROM (SELECT series_id, t, round(sqrt(t * (n - t) / CAST(n AS DOUBLE)) * abs(({_purity('l')}) - ({_purity('r')})), 6) AS q FROM f {_WINDOWS} QUALIFY t BETWEEN {W} AND n - {W})")
def i1_order2_information_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scans.order2_information_scan(pairs(spark, sf_dir), THREE, W))


_VECTOR_PAIRS = " UNION ALL ".join(f"SELECT 'e/{i}/{j}' AS series_id, row_number() OVER (ORDER BY vec_id) AS t, count(*) OVER () AS n, CAST(embedding[{i + 1}] AS DOUBLE) AS x, CAST(embedding[{j + 3}] AS DOUBLE) AS y FROM embeddings" for i in range(2) for j in range(2))


@query(f"WITH pairs AS ({_VECTOR_PAIRS}), {_RANKED.format(source='pairs')}, {_SPEARMAN} SELECT 'e' AS series_id, t, round(avg(q), 6) AS q FROM curve GROUP BY t")
def i9_vector_spearman_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from tidewatch.plans.fixtures import table

    e = table(spark, sf_dir, "embeddings")
    t = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("vec_id")).cast("long")
    rows = e.select(F.lit("e").alias("block_id"), t.alias("t"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"), F.slice("embedding", 1, 2).alias("u"), F.slice("embedding", 3, 2).alias("v"))
    return scan(scans.vector_spearman_scan(rows, "u", "v", W))
