"""Queries that need eigenvalues, random draws or optimisers (classes U): held against NumPy in the tests, rows only elsewhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import detection as dt
from tidewatch.functions import spectra as sp
from tidewatch.functions.special import clopper_pearson, ks_uniform_p
from tidewatch.operators import detect, evaluate
from tidewatch.operators.ranks import correlation
from tidewatch.plans.fixtures import hourly, pairs, rounded, table
from tidewatch.plans.registry import query

UNIT, REPLICAS, CHUNKS = 40, 99, 8


def _features(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sp.pair_features(x, y, dt.DIM, dt.SEED)


def _scan(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    return rounded(detect.curve(hourly(spark, sf_dir), make), "q")


@query()
def f1_feature_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = detect.interval_moments(pairs(spark, sf_dir))
    return rounded(m.select("series_id", "interval", "cnt", F.aggregate("mx", F.lit(0.0), lambda a, v: a + v).alias("mx"), F.aggregate("mj", F.lit(0.0), lambda a, v: a + v).alias("mj")), "mx", "mj")


@query()
def i3_information_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.moment_curve(detect.interval_moments(pairs(spark, sf_dir))), "q")


@query()
def i3_dense_information_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split of every hourly series."""
    return rounded(detect.dense_curve(hourly(spark, sf_dir), w=20, pieces=16), "q")


@query()
def i1_i25_information_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        t = sp.fraction_grid(len(x))
        left, right = sp.information_sides(*_features(x, y), t)
        share = t / len(x)
        return {"t": t.astype(np.int64), "left": left, "right": right, "process": np.sqrt(share * (1 - share)) * np.abs(len(x) * (left - right))}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "t long, left double, right double, process double"), "left", "right", "process")


@query()
def i2_corrected_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        fx, fy = _features(x, y)
        o = np.random.default_rng(dt.SEED + 99).permutation(len(x))
        t = sp.fraction_grid(len(x))
        seen, null = sp.information_sides(fx, fy, t)[0], sp.information_sides(fx, fy[o], t)[0]
        return {"t": t.astype(np.int64), "q": seen - null}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "t long, q double"), "q")


@query()
def i4_unweighted_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x, y, t):
        u, v = sp.ranks01(x), sp.ranks01(y)
        fx, fy = (sp.features(a, dt.DIM, s, 2 * sp.bandwidth(a, s)) for a, s in ((u, dt.SEED), (v, dt.SEED + 1)))
        return dt.information_curve(fx, fy, t, weighted=False, entropy=sp.ent15)

    return _scan(spark, sf_dir, make)


@query()
def i5_joint_state_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, lambda x, y, t: dt.state_curve(sp.products(*_features(x, y)), t))


def _state_features(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = np.column_stack([x, y])
    f = sp.features((z - z.mean(axis=0)) / z.std(axis=0), 32, 0, unit=False)
    return np.column_stack([f, np.ones(len(f))])


@query()
def i6_state_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, lambda x, y, t: dt.state_curve(_state_features(x, y), t))


@query()
def i6_spectral_state_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, lambda x, y, t: dt.state_curve(_state_features(x, y), t, spectral=True))


def _units(x, y):
    return sp.ranks01(x)[:, 0], sp.ranks01(y)[:, 0]


@query()
def i16_gram_order1_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x, y, t):
        u, v = _units(x, y)
        return dt.gram_curve(u, v, t, *(1 / sp.median_square_distance(a[:, None]) for a in (u, v)), rows=64)

    return rounded(detect.curve(hourly(spark, sf_dir), make), "q")


@query()
def i20_canonical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir, lambda x, y, t: dt.canonical_curve(*_features(x, y), t))


@query()
def i19_dcc_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        t = sp.fraction_grid(len(x))
        path = dt.dcc_path(*(dt.garch_residuals(a) for a in (x, y)))
        return {"t": t.astype(np.int64), "q": dt.mean_cusum(path, t)}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "t long, q double"), "q")


@query()
def i22_renyi_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        at, tc = dt.renyi_series(x, y + 1e-9 * np.arange(len(y)))
        return {"t": at.astype(np.int64), "tc1": tc[1.01], "tc2": tc[2.0]}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "t long, tc1 double, tc2 double"), "tc1", "tc2")


@query()
def i24_bg_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        j, t, q = dt.bg_split(x)
        return {"tau": j, "t_max": t, "q": q, "breaks": len(dt.bg_segments(x, 0.0513))}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "tau long, t_max double, q double, breaks int"), "t_max", "q")


@query()
def i26_combined_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger of two studentized maxima, with its place."""
    from tidewatch.operators.scans import spearman_scan

    a = detect.moment_curve(detect.interval_moments(pairs(spark, sf_dir))).select("series_id", F.col("interval").alias("t"), "q").withColumn("stat", F.lit("information"))
    b = spearman_scan(pairs(spark, sf_dir)).withColumn("stat", F.lit("spearman"))
    w = Window.partitionBy("series_id", "stat")
    z = a.unionByName(b).withColumn("z", (F.col("q") - F.avg("q").over(w)) / (F.stddev_pop("q").over(w) + 1e-12))
    return rounded(z.groupBy("series_id").agg(F.max("z").alias("t_max"), F.max_by("t", F.struct(F.round("z", 9), F.col("stat") == "information", -F.col("t"))).alias("tau")), "t_max")


@query()
def i27_feature_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x, y, t):
        return np.mean([dt.information_curve(*sp.pair_features(x, y, dt.DIM, dt.SEED + 10 * k), t) for k in range(6)], axis=0)

    return _scan(spark, sf_dir, make)


def _information(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    return dt.information_curve(*_features(x, y), t)


def _tests(df: DataFrame, replicas: int, seed: int, make=_information, **shuffled) -> DataFrame:
    return rounded(detect.permutation_test(df, make, replicas, CHUNKS, seed, **shuffled), "t_max", "p")


@query()
def j1_j11_pair_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tests(hourly(spark, sf_dir), 19, 1)


@query()
def j2_block_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tests(hourly(spark, sf_dir).withColumn("block", F.lit(12)), 19, 1)


@query()
def j2_interval_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = detect.interval_moments(pairs(spark, sf_dir))
    return rounded(detect.moment_test(m, REPLICAS, CHUNKS, 7), "observed", "p")


@query()
def j3_stratified_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = detect.interval_moments(pairs(spark, sf_dir))
    return rounded(detect.moment_test(m, REPLICAS, CHUNKS, 7, strata=lambda k: k % 4), "observed", "p")


@query()
def j4_one_sided_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invalid control: y alone is shuffled."""
    return _tests(hourly(spark, sf_dir), 19, 3, shuffled=lambda x, y, _, rng: (x, rng.permutation(y)))


@query()
def j5_reused_features_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features made once and permuted, instead of made anew for each copy: copies are orders of the feature rows."""

    def ordered(x, y, _, rng):
        return np.column_stack([x, y]), rng.permutation(len(x))

    def make(x, y, t):
        if x.ndim == 1:
            return _information(x, y, t)
        fx, fy = _features(*x.T)
        return dt.information_curve(fx[y], fy[y], t)

    return _tests(hourly(spark, sf_dir), 19, 1, make=make, shuffled=ordered)


@query()
def j12_adaptive_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostic decides between pairs and blocks, then the test."""
    from tidewatch.plans.pipelines import adaptive

    return rounded(adaptive(hourly(spark, sf_dir), 19, CHUNKS, 1, least=1), "t_max", "p")


@query()
def j15_whole_procedure_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploratory: the best cut's statistic against the best of permuted records, adjusted by the maximum."""

    def one(x, y):
        rng, z = np.random.default_rng(5), np.column_stack(_units(x, y))
        best = lambda a: (lambda f: f[0] if f else (0, 0.0))(dt.binary_segmentation(dt.mmd_gain(a, 40), len(a), 40, 1))
        t, g = best(z)
        null = []
        for _ in range(19):
            o = dt.block_order(len(z), 12, rng)
            null.append(best(z[o])[1])
        return {"tau": t, "gain": g, "p_adjusted": float((1 + dt.reaches(np.array(null), g).sum()) / 20)}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "tau long, gain double, p_adjusted double"), "gain", "p_adjusted")


@query()
def k1_exchangeability(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        e = dt.exchangeability(x, y)
        return {"stat": ["level_x", "level_y", "square_x", "square_y", "cross"], "p": e["p"], "p_limit": e["p_limit"], "tau": e["tau"], "block": bool(e["block"])}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "stat string, p double, p_limit double, tau double, block boolean"), "p", "p_limit", "tau")


@query()
def k6_block_summary_portmanteau(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        v = np.log(x[: len(x) // 12 * 12].reshape(-1, 12).var(axis=1) + 1e-12)
        box = lambda a: (lambda r, k: len(a) * (len(a) + 2) * (r * r / (len(a) - k)).sum())(dt.autocorrelations(a, 5), np.arange(1, 6))
        rng, seen = np.random.default_rng(11), box(v)
        return {"q": seen, "p": float((1 + sum(bool(dt.reaches(box(rng.permutation(v)), seen)) for _ in range(499))) / 500)}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "q double, p double"), "q", "p")


@query()
def l1_state_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.moment_costs(detect.interval_moments(hourly(spark, sf_dir), UNIT)), "c")


@query()
def l1_l4_state_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators import segment

    arrays = segment.cost_arrays(detect.moment_costs(detect.interval_moments(pairs(spark, sf_dir), pieces=40)))
    out = segment.optimal_partition(arrays, F.lit(2.0))
    return rounded(out.withColumn("cuts", F.concat_ws(",", F.transform("cuts", lambda c: c.cast("string")))), "value")


@query()
def l5_l6_calibrated_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        cuts, beta = dt.calibrated_partition(x, y, 24, [0.5, 1.0, 2.0, 4.0, 8.0, 16.0], 5, 3)
        return {"beta": beta, "cuts": ",".join(map(str, cuts))}

    return detect.by_series(hourly(spark, sf_dir), one, "beta double, cuts string")


@query()
def l7_binary_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        found = dt.binary_segmentation(dt.mmd_gain(np.column_stack(_units(x, y)), 30), len(x), 30, 4)
        return {"place": np.arange(len(found)), "tau": np.array([t for t, _ in found]), "gain": np.array([g for _, g in found])}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "place long, tau long, gain double"), "gain")


@query()
def l8_recursive_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.by_series(hourly(spark, sf_dir), lambda x, y: {"cuts": ",".join(map(str, dt.recursive_breaks(x, y, 20, 19, 0.05, 1, 2, 100)))}, "cuts string")


@query()
def l9_energy_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.by_series(hourly(spark, sf_dir), lambda x, y: {"cuts": ",".join(map(str, dt.energy_segments(np.column_stack(_units(x, y)), 19, least=40)))}, "cuts string")


@query()
def l10_bg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.by_series(hourly(spark, sf_dir), lambda x, y: {"cuts": ",".join(map(str, dt.bg_segments(x, 3.0)))}, "cuts string")


@query()
def l11_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the partition, tested again in their windows, with q-values and classes."""

    def one(x, y):
        found = dt.two_stage(x, y, 24, [0.25, 0.5, 1.0, 2.0, 4.0], 72, 19, 5)
        return {"date": np.array([c for c, *_ in found], np.int64), "p": np.array([p for _, p, _ in found], float), "tau": np.array([t for *_, t in found], np.int64)}

    rows = detect.by_series(hourly(spark, sf_dir), one, "date long, p double, tau long").withColumn("family", F.lit(1))
    q = evaluate.step_up_q(rows, ["family"], "p", "q").withColumn("p_marginal", F.lit(1.0))
    return rounded(evaluate.classified(q, "q", "p_marginal", ("dependence change", "both change", "marginal change", "no change")).drop("family", "p_marginal"), "p", "q")


@query()
def l12_random_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = detect.random_dates(hourly(spark, sf_dir), ["series_id"], "t", 10, 120, 9)

    def run(pdf):
        import pandas as pd

        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "n": [len(pdf)], "p_uniform": [ks_uniform_p(pdf["at"].to_numpy() / 720.0)]})

    return rounded(at.groupBy("series_id").applyInPandas(run, "series_id string, n long, p_uniform double"), "p_uniform")


@query()
def m9_clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 60).alias("k"), F.count("*").alias("n"))

    def run(batches):
        for pdf in batches:
            lo, hi = zip(*(clopper_pearson(int(k), int(n)) for k, n in zip(pdf["k"], pdf["n"]))) if len(pdf) else ((), ())
            yield pdf.assign(lo=lo, hi=hi)

    return rounded(hits.mapInPandas(run, "event_type string, k long, n long, lo double, hi double"), "lo", "hi")


@query()
def f14_bootstrap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.by_series(hourly(spark, sf_dir), lambda x, y: {"median": float(np.median(x)), "se": dt.bootstrap_median_se(x, 200)}, "median double, se double"), "median", "se", digits=4)


@query()
def n3_asymptotic_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "c double, n_weights int, t_raw double, crit_raw double, p_raw double, tau_raw long, t_std double, crit_std double, p_std double, tau_std long"
    return rounded(detect.by_series(hourly(spark, sf_dir), lambda x, y: dt.asymptotic_test(x, y, 500), schema), "c", "t_raw", "crit_raw", "p_raw", "t_std", "crit_std", "p_std", digits=4)


@query()
def n4_exact_null_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maxima of the scan process for independent ranks, one draw a row."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k in pdf["id"]:
                rng = np.random.default_rng([77, int(k)])
                g = sp.fraction_grid(400)
                left, right = sp.information_sides(*_features(rng.random(400), rng.random(400)), g)
                out.append(float((np.sqrt(g / 400 * (1 - g / 400)) * np.abs(400 * (left - right))).max()))
            yield pd.DataFrame({"draw": pdf["id"], "t_max": out})

    return rounded(spark.range(16).repartition(4).mapInPandas(run, "draw long, t_max double"), "t_max", digits=4)


@query()
def g_generated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [("D1", 0.5, 0), ("D2", 0.7, 1), ("D3", 0.5, 0), ("D4", 0.7, 0), ("M1", 2.0, 0), ("M2", 0.7, 0), ("N1", 0.7, 0), ("N2", 4.0, 0), ("N3", 0.7, 0), ("G2", 0.35, 1), ("G3", 0.35, 1)]
    rows = detect.generated(detect.replicates(spark, cells, 1, False))
    return rounded(rows.groupBy("scen", F.col("t") > 300).agg(correlation("x", "y").alias("r"), F.stddev_pop("y").alias("sd"), F.count("*").alias("n")).withColumnRenamed("(t > 300)", "after"), "r", "sd")


@query()
def e1_power_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from each level's own null."""
    return rounded(detect.power_study(spark, [("D1", 0.7, 2), ("D2", 0.9, 2)], 12, _information), "power", "detect_rate", "loc_err_median")


@query()
def j14_lowest_null_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from the null of the scenario's lowest level."""
    out = detect.power_study(spark, [("M2", 0.5, 1), ("M2", 0.9, 3)], 12, _information, lowest=[("M2", 0.3, 0)])
    return rounded(out, "power", "detect_rate", "loc_err_median")


@query()
def h1_bandwidths(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        return {"gx": sp.bandwidth(sp.ranks01(x), dt.SEED), "gy": sp.bandwidth(sp.ranks01(y), dt.SEED + 1)}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "gx double, gy double"), "gx", "gy")


@query()
def h_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        f = sp.products(*_features(x, y))
        m = f.T @ f / len(f)
        return {"kind": list(sp.ENTROPIES), "entropy": np.array([float(e(m)) for e in sp.ENTROPIES.values()])}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "kind string, entropy double"), "entropy")


@query()
def h7_low_rank_gram_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(x, y, t):
        u, v = _units(x, y)
        return dt.low_rank_gram_curve(u, v, t, *(1 / sp.median_square_distance(a[:, None]) for a in (u, v)))

    return rounded(detect.curve(hourly(spark, sf_dir), make), "q")


@query()
def h9_bias_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x, y):
        fx, fy = _features(x, y)
        return {"bx": dt.bias_coefficient(fx), "by": dt.bias_coefficient(fy), "bj": dt.bias_coefficient(sp.products(fx, fy))}

    return rounded(detect.by_series(hourly(spark, sf_dir), one, "bx double, by double, bj double"), "bx", "by", "bj")


@query()
def p_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.plans.pipelines import panel

    return rounded(panel(hourly(spark, sf_dir), 19, CHUNKS, 3), "t_max", "p", "q", "q_dependent", "r_before", "r_after")


@query()
def p_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.plans.pipelines import two_stage

    out = two_stage(pairs(spark, sf_dir), 40, 10.0, 39, 4, 12, 5)
    return rounded(out, "observed", "p", "q", "p_marginal")


@query()
def p_split_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.plans.pipelines import split_halves

    out = split_halves(pairs(spark, sf_dir), 20, 1, 24, 1.0, 39, 4, 6, 5)
    return rounded(out, "observed", "p", "q", "p_marginal")


def _spearman(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """sqrt(weight) times the difference of the sides' correlations of ranks."""
    u, v = _units(x, y)
    sums = [np.concatenate([[0.0], np.cumsum(a)]) for a in (u, v, u * u, v * v, u * v)]
    rho = []
    for m, side in ((t, [s[t] for s in sums]), (len(x) - t, [s[-1] - s[t] for s in sums])):
        a, b, aa, bb, ab = (s / m for s in side)
        rho.append((ab - a * b) / np.sqrt((aa - a * a) * (bb - b * b) + 1e-12))
    return np.sqrt(dt.weights(t, len(x))) * np.abs(rho[0] - rho[1])


@query()
def p_statistics_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three statistics over the same replicates: correlation appears, and dependence without it."""
    from tidewatch.plans.pipelines import statistics_study

    grams = lambda x, y, t: dt.gram_order2_curve(*_units(x, y), t, *(sp.bandwidth(a[:, None], dt.SEED + k) for k, a in enumerate(_units(x, y))))
    out = statistics_study(spark, [("D1", 0.8, 2), ("D2", 0.9, 2)], 10, {"information": _information, "order2": grams, "spearman": _spearman})
    return rounded(out, "power", "detect_rate", "loc_err_median")


@query()
def p_segmentation_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.plans.pipelines import segmentation_study

    def states(x, y):
        grid = np.arange(0, len(x) + 1, 75)
        return [int(grid[k]) for k in dt.partition(dt.state_costs(sp.products(*_features(x, y)), grid), 8.0)]

    methods = {"products": lambda x, y: dt.bg_segments(x * y, 3.0), "scales": lambda x, y: dt.bg_segments(np.abs(x) * np.abs(y), 3.0), "states": states}
    return rounded(segmentation_study(spark, [(0.8, 0), (0.9, 1)], 4, methods), "mean_k", "k_correct", "hausdorff_median", "ari_mean", "recall_mean")
