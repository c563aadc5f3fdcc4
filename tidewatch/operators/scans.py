"""Curves of change statistics over the split t of a series (rows 1..t against the rest).

Every function takes rows (series_id, t, x, y, n) with t = 1..n and returns (series_id, t, q) for the splits w <= t <= n - w. Segments
are differences of running sums; weights are as named. Statistics on pairs of rows cost n^2 per series, in tiles (`tiles`): a long series is many
tasks, and pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.spectra import fraction_grid
from tidewatch.operators import tiles
from tidewatch.operators.prefix import ordinal_ranks, rank_splits, running_sums

KEY = ["series_id"]


def d(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def on_grid(df: DataFrame, w: int) -> DataFrame:
    return df.filter((F.col("t") >= w) & (F.col("t") <= F.col("n") - w))


def accumulated(df: DataFrame, sums: dict[str, str], block: int | None = None) -> DataFrame:
    """Running sums and, as <name>_all, those of the whole series (a long series' as one row of aggregates)."""
    run = running_sums(df, KEY, "t", sums, block)
    if block is None:
        every = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return run.withColumns({f"{c}_all": F.last(c).over(every) for c in sums})
    return run.join(df.groupBy(*KEY).agg(*(F.sum(F.expr(e)).alias(f"{c}_all") for c, e in sums.items())), KEY)


def weight() -> Column:
    return d("t") * (d("n") - d("t")) / d("n")


def ranked(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """Ordinal ranks _rx and _ry of x and y, ties in order of time; those of long series within ranges of about so many rows."""
    for c in ("x", "y"):
        df = ordinal_ranks(df, KEY, [c, "t"], f"_r{c}", rank_splits(df, c, ranges) if ranges else None)
    return df


def centred_ranks(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """Integers a = 2 rank(x) - (n + 1) and b for y."""
    return ranked(df, ranges).withColumns({"a": 2 * F.col("_rx") - F.col("n") - 1, "b": 2 * F.col("_ry") - F.col("n") - 1}).drop("_rx", "_ry")


def spearman_scan(df: DataFrame, w: int = 60, block: int | None = None, ranges: int | None = None) -> DataFrame:
    """sqrt(weight) times the absolute difference of the segments' correlations of whole-series ranks.

    Sums of products are exact whatever the length: in two words, the upper one counting 2^31. A long series is many tasks: runs of `block`
    positions are summed first, and values are ranked in `ranges` of about so many rows.
    """
    sums = {"sa": "a", "sb": "b"} | {f"s{p}_{word}": how.format(" * ".join(p)) for p in ("aa", "bb", "ab") for word, how in (("h", "shiftright({}, 31)"), ("l", "({}) & 2147483647L"))}
    run = accumulated(centred_ranks(df, ranges), sums, block)

    def rho(part: str, m: Column) -> Column:
        one = lambda c: d(c) if part == "left" else d(F.col(f"{c}_all") - F.col(c))
        of = lambda c: one(c) if len(c) == 2 else one(f"{c}_h") * 2147483648.0 + one(f"{c}_l")
        unit = 4.0 * (d("n") + 1) * (d("n") + 1)
        ma, mb = of("sa") / m, of("sb") / m
        return ((of("sab") / m - ma * mb) / unit) / F.sqrt((of("saa") / m - ma * ma) / unit * ((of("sbb") / m - mb * mb) / unit) + F.lit(1e-12))

    q = F.sqrt(weight()) * F.abs(rho("left", d("t")) - rho("right", d("n") - d("t")))
    return on_grid(run, w).select("series_id", "t", q.alias("q"))


def gauss_lr_scan(df: DataFrame, w: int = 60, ridge: float = 1e-3) -> DataFrame:
    """n logdet C - n1 logdet C1 - n2 logdet C2 with ridged 2x2 covariances in closed form."""
    sums = {"sx": "x", "sy": "y", "sxx": "x * x", "syy": "y * y", "sxy": "x * y"}
    run = on_grid(accumulated(df, sums), w)

    def logdet(part: str, m: Column) -> Column:
        of = lambda c: {"left": d(c), "right": d(f"{c}_all") - d(c), "all": d(f"{c}_all")}[part]
        mx, my = of("sx") / m, of("sy") / m
        vx, vy, c = of("sxx") / m - mx * mx, of("syy") / m - my * my, of("sxy") / m - mx * my
        tr = vx + vy
        root = F.sqrt(F.greatest((vx - vy) * (vx - vy) + 4.0 * c * c, F.lit(0.0)))
        add = F.lit(ridge) * F.greatest(tr, F.lit(1e-12)) / 2.0
        return F.log(F.greatest((tr + root) / 2.0, F.lit(0.0)) + add) + F.log(F.greatest((tr - root) / 2.0, F.lit(0.0)) + add)

    left, right, n = d("t"), d("n") - d("t"), d("n")
    return run.select("series_id", "t", (n * logdet("all", n) - left * logdet("left", left) - right * logdet("right", right)).alias("q"))


def corr_cusum(df: DataFrame, w: int = 60) -> DataFrame:
    """t / sqrt(n) times the absolute difference of the correlation up to t (of globally standardised values, not centred again) and the whole one."""
    every = Window.partitionBy("series_id")
    std = df.withColumns({f"z{c}": F.try_divide(F.col(c) - F.avg(c).over(every), F.stddev_pop(c).over(every)) for c in ("x", "y")})
    sums = {"cxy": "zx * zy", "cx": "zx * zx", "cy": "zy * zy"}
    run = accumulated(std, sums)
    rho = lambda s: F.try_divide(F.col(f"cxy{s}"), F.sqrt(F.col(f"cx{s}") * F.col(f"cy{s}")))
    return on_grid(run, w).select("series_id", "t", (d("t") / F.sqrt(d("n")) * F.abs(rho("") - rho("_all"))).alias("q"))


def scale_scan(df: DataFrame, lo: int = 3) -> DataFrame:
    """From interval sums (series_id, t, s1, s2, cnt; n intervals): weighted difference of log standard deviations."""
    sums = {"c1": "s1", "c2": "s2", "cn": "cnt"}
    run = on_grid(accumulated(df, sums), lo)
    nl, nr = d("cn"), d("cn_all") - d("cn")
    vl = F.col("c2") / nl - F.pow(F.col("c1") / nl, 2)
    vr = (F.col("c2_all") - F.col("c2")) / nr - F.pow((F.col("c1_all") - F.col("c1")) / nr, 2)
    floor = lambda v: F.log(F.greatest(v, F.lit(1e-12)))
    return run.select("series_id", "t", (F.sqrt(nl * nr / d("cn_all")) * F.abs(floor(vl) - floor(vr)) / 2.0).alias("q"))


def bg_tstat(df: DataFrame, l0: int = 25) -> DataFrame:
    """Pooled-variance t statistic of the difference of means of x."""
    sums = {"c1": "x", "c2": "x * x"}
    run = on_grid(accumulated(df, sums), l0)
    nl, nr = d("t"), d("n") - d("t")
    ml, mr = F.col("c1") / nl, (F.col("c1_all") - F.col("c1")) / nr
    ss = F.greatest(F.col("c2") - nl * ml * ml, F.lit(0.0)) + F.greatest(F.col("c2_all") - F.col("c2") - nr * mr * mr, F.lit(0.0))
    sp = F.sqrt(ss / (d("n") - 2)) * F.sqrt(1.0 / nl + 1.0 / nr)
    return run.select("series_id", "t", F.when(sp > 0, F.abs(ml - mr) / sp).otherwise(0.0).alias("q"))


# ---- statistics on pairs of rows


def row_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All ordered pairs (i, j) of a series with both rows' columns."""
    one = df.select("series_id", "n", F.col("t").alias("i"), *(F.col(c).alias(f"{c}i") for c in cols))
    other = df.select("series_id", F.col("t").alias("j"), *(F.col(c).alias(f"{c}j") for c in cols))
    return one.join(other, KEY)


def rank_units(df: DataFrame) -> DataFrame:
    """x and y replaced by their ranks over n + 1."""
    return ranked(df).select("series_id", "t", "n", (F.col("_rx") / (F.col("n") + 1.0)).alias("x"), (F.col("_ry") / (F.col("n") + 1.0)).alias("y"))


def median_square_distance(pairs: DataFrame, expr: Column, name: str) -> DataFrame:
    """The median over i < j per series; 1 where it is 0."""
    med = F.percentile("_d", F.lit(0.5))
    return pairs.filter("i < j").select("series_id", expr.alias("_d")).groupBy("series_id").agg(F.when(med > 0, med).otherwise(1.0).alias(name))


def gram_order2_scan(df: DataFrame, w: int = 60) -> DataFrame:
    """sqrt(weight) |I_L - I_R| with I = log(S_xy m^2 / (S_x S_y)) over squared Gaussian kernels of ranks."""

    def tile(rows: np.ndarray, v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        med = tiles.rank_square_median(len(v["x"]))
        kx, ky = (np.exp(-2.0 * (v[c][rows, None] - v[c]) ** 2 / med) for c in "xy")
        return tiles.square_parts(rows, kx, "kx") | tiles.square_parts(rows, ky, "ky") | tiles.square_parts(rows, kx * ky, "kxy")

    names = ["kx", "ky", "kxy"]
    s = on_grid(tiles.squares(tiles.tiled(rank_units(df), "xy", tile, [f"{c}_{k}" for c in names for k in ("up", "down")]), names), w)
    i2 = lambda part, m: F.log(F.col(f"kxy_{part}") * m * m / (F.col(f"kx_{part}") * F.col(f"ky_{part}")))
    return s.select("series_id", "t", (F.sqrt(weight()) * F.abs(i2("l", d("t")) - i2("r", d("n") - d("t")))).alias("q"))


def mmd_scan(df: DataFrame, w: int = 60, mult: float = 1.0) -> DataFrame:
    """weight * max(mean k_LL + mean k_RR - 2 mean k_LR, 0), Gaussian kernel of (x, y) at the median distance."""
    p = row_pairs(df, ["x", "y"])
    dist = F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2)
    scaled = df.join(median_square_distance(p, dist, "med"), KEY)

    def tile(rows: np.ndarray, v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        far = sum((v[c][rows, None] - v[c]) ** 2 for c in "xy")
        return tiles.square_parts(rows, np.exp(-far / (v["med"][0] * mult)), "k")

    s = on_grid(tiles.squares(tiles.tiled(scaled, ["x", "y", "med"], tile, ["k_up", "k_down"]), ["k"]), w)
    left, right = d("t"), d("n") - d("t")
    cross = (F.col("k_a") - F.col("k_l") - F.col("k_r")) / 2.0
    value = F.col("k_l") / (left * left) + F.col("k_r") / (right * right) - 2.0 * cross / (left * right)
    return s.select("series_id", "t", (weight() * F.greatest(value, F.lit(0.0))).alias("q"))


def hsic_gram_scan(df: DataFrame, w: int = 60, mult: float = 1.0) -> DataFrame:
    """|HSIC_L - HSIC_R| (biased, no weight), Gaussian kernels of ranks with sigma = median distance * mult."""

    def tile(rows: np.ndarray, v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        sigma = max(tiles.rank_distance_median(len(v["x"])) * mult, 1e-12)
        kx, ky = (np.exp(-((v[c][rows, None] - v[c]) ** 2) / (2 * sigma**2)) for c in "xy")
        parts = tiles.square_parts(rows, kx, "kx") | tiles.square_parts(rows, ky, "ky") | tiles.square_parts(rows, kx * ky, "kxy")
        return parts | tiles.row_product_parts(rows, kx, ky, "rows")

    names = ["kx", "ky", "kxy"]
    s = on_grid(tiles.squares(tiles.tiled(rank_units(df), "xy", tile, [*(f"{c}_{k}" for c in names for k in ("up", "down")), "rows_l", "rows_r"]), names), w)
    value = lambda p_, m: (F.col(f"kxy_{p_}") - 2.0 * F.col(f"rows_{p_}") / m + F.col(f"kx_{p_}") * F.col(f"ky_{p_}") / (m * m)) / (m * m)
    return s.select("series_id", "t", F.abs(value("l", d("t")) - value("r", d("n") - d("t"))).alias("q"))


def dcor_scan(df: DataFrame, w: int = 60) -> DataFrame:
    """sqrt(weight) |dCor_L - dCor_R| on ranks: distance covariances from sums of products, of rows and of all."""
    names, both = ["a", "b", "ab", "aa", "bb"], ["ab", "aa", "bb"]

    def tile(rows: np.ndarray, v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        m = {"a": np.abs(v["x"][rows, None] - v["x"]), "b": np.abs(v["y"][rows, None] - v["y"])}
        parts = {}
        for c in names:
            parts |= tiles.square_parts(rows, m[c[0]] * m[c[1]] if len(c) == 2 else m[c], c)
        for c in both:
            parts |= tiles.row_product_parts(rows, m[c[0]], m[c[1]], f"w{c}")
        return parts

    made = [*(f"{c}_{k}" for c in names for k in ("up", "down")), *(f"w{c}_{k}" for c in both for k in "lr")]
    s = on_grid(tiles.squares(tiles.tiled(rank_units(df), "xy", tile, made), names), w)

    def cov(c: str, part: str, m: Column) -> Column:
        return F.col(f"{c}_{part}") / (m * m) - 2.0 * F.col(f"w{c}_{part}") / (m * m * m) + F.col(f"{c[0]}_{part}") * F.col(f"{c[1]}_{part}") / (m * m * m * m)

    def dcor(part: str, m: Column) -> Column:
        return F.sqrt(F.greatest(cov("ab", part, m), F.lit(0.0)) / F.sqrt(cov("aa", part, m) * cov("bb", part, m) + F.lit(1e-18)))

    return s.select("series_id", "t", (F.sqrt(weight()) * F.abs(dcor("l", d("t")) - dcor("r", d("n") - d("t")))).alias("q"))


def _dominated(rows: np.ndarray, v: dict[str, np.ndarray]) -> np.ndarray:
    """Which positions lie at or below each of a tile's rows, in both coordinates."""
    return (v["x"] <= v["x"][rows, None]) & (v["y"] <= v["y"][rows, None])


def dominance_counts(df: DataFrame) -> DataFrame:
    """(series_id, t, dominated): how many rows of the series have neither a larger x nor a larger y."""

    def tile(rows: np.ndarray, v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = np.zeros(len(v["x"]))
        out[rows] = _dominated(rows, v).sum(axis=1)
        return {"dominated": out}

    return tiles.tiled(df, "xy", tile, ["dominated"]).select("series_id", "t", F.col("dominated").cast("long").alias("dominated"))


def copula_cvm_scan(df: DataFrame, w: int = 60) -> DataFrame:
    """weight * mean over rows j of (C_L(U_j) - C_R(U_j))^2 with whole-series ranks; dominance counts are exact integers."""

    def tile(rows: np.ndarray, v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        c = np.cumsum(_dominated(rows, v), axis=1, dtype=float)
        every = c[:, -1:]
        return {"cc": (c * c).sum(axis=0), "ca": (c * every).sum(axis=0), "aa": np.full(c.shape[1], float((every * every).sum()))}

    g = tiles.tiled(rank_units(df), "xy", tile, ["cc", "ca", "aa"])
    t, r, n = d("t"), d("n") - d("t"), d("n")
    # (c/t - (all-c)/r)^2 = (c n/(t r) - all/r)^2
    mean = (d("cc") * n * n / (t * t * r * r) - 2.0 * d("ca") * n / (t * r * r) + d("aa") / (r * r)) / n
    return on_grid(g, w).select("series_id", "t", (weight() * mean).alias("q"))


def copula_cvm_subsample_scan(df: DataFrame, grid: Callable[[int], np.ndarray] = fraction_grid, splits: int = 16) -> DataFrame:
    """S_n(k) with ranks made anew on either side: (k (n-k) / n^1.5)^2 times the mean squared difference of the sides' empirical copulas.

    Splits of `grid`; so many of them, with the series, are one task.
    """
    whole = tiles.columns(rank_units(df), "xy")
    chunks = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.col("n") / splits).cast("int")))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, chunk = int(pdf["n"].iloc[0]), int(pdf["chunk"].iloc[0])
        g = np.rint(np.column_stack([pdf["x"].iloc[0], pdf["y"].iloc[0]]) * (n + 1)).astype(np.int64)  # whole-series ranks
        out = []
        for k in grid(n)[chunk * splits : (chunk + 1) * splits]:
            sides = []
            for part in (g[:k], g[k:]):
                m = len(part)
                at = np.argsort(np.argsort(part, axis=0), axis=0) + 1
                # rank / m <= g / n, in integers: a place of the side's grid for each point of the whole
                limit = g * m // n
                counts = np.zeros((m + 1, m + 1), np.int64)
                counts[at[:, 0], at[:, 1]] = 1
                counts = counts.cumsum(axis=0).cumsum(axis=1)
                sides.append(counts[limit[:, 0], limit[:, 1]] / m)
            out.append((int(k), (k * (n - k) / n**1.5) ** 2 * float(np.mean((sides[0] - sides[1]) ** 2))))
        if not out:
            return pd.DataFrame()  # an empty text column can't be handed over
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]] * len(out), "t": np.array([k for k, _ in out], np.int64), "q": np.array([q for _, q in out], float)})

    kind = df.schema["series_id"].dataType.simpleString()
    return chunks.groupBy("series_id", "chunk").applyInPandas(run, f"series_id {kind}, t long, q double")


def arg_max(curve: DataFrame, keys: Sequence[str] = KEY, digits: int = 9) -> DataFrame:
    """The largest value of each curve and its first split."""
    best = F.max_by("t", F.struct(F.round("q", digits), -F.col("t")))
    return curve.groupBy(*keys).agg(F.max("q").alias("q_max"), best.alias("tau_hat"))


def _unit_features(u: DataFrame, features: tuple[Sequence[float], ...]) -> tuple[DataFrame, list[str], list[str]]:
    """The rows with columns f0.. of x and g0.. of y, each side of unit length."""
    wx, bx, wy, by = features
    unit = lambda c, ws, bs: [F.sqrt(F.lit(2.0 / len(ws))) * F.cos(F.col(c) * F.lit(float(a)) + F.lit(float(b))) for a, b in zip(ws, bs)]
    fx = {f"f{k}": e for k, e in enumerate(unit("x", wx, bx))}
    fy = {f"g{k}": e for k, e in enumerate(unit("y", wy, by))}
    norm = lambda cs: F.sqrt(sum((F.col(c) * F.col(c) for c in cs), F.lit(0.0)))
    rows = u.withColumns(fx | fy).withColumns({"nf": norm(fx), "ng": norm(fy)})
    return rows.withColumns({c: F.col(c) / F.col("nf") for c in fx} | {c: F.col(c) / F.col("ng") for c in fy}), list(fx), list(fy)


def feature_scan(df: DataFrame, features: tuple[Sequence[float], Sequence[float], Sequence[float], Sequence[float]], w: int, kind: str) -> DataFrame:
    """Scans on random cosine features of ranks, without eigenvalues: kind `hsic` or `frobenius`.

    features: frequencies and phases for x and for y, drawn on the driver and inlined as literals (a few numbers).
    """
    rows, fx, fy = _unit_features(rank_units(df), features)
    sums = {f"s_{a}_{b}": f"{a} * {b}" for a in fx for b in fy} | {f"s_{a}": a for a in (*fx, *fy)} if kind == "hsic" else {f"s_{a}_{b}": f"{a} * {b}" for a in fx for b in fx if a <= b}
    run = on_grid(accumulated(rows.select("series_id", "t", "n", *fx, *fy), sums), w)
    left, right = d("t"), d("n") - d("t")
    of = lambda c, part: F.col(c) / left if part == "left" else (F.col(f"{c}_all") - F.col(c)) / right
    if kind == "hsic":
        square = lambda part: sum((F.pow(of(f"s_{a}_{b}", part) - of(f"s_{a}", part) * of(f"s_{b}", part), 2) for a in fx for b in fy), F.lit(0.0))
        return run.select("series_id", "t", (F.sqrt(weight()) * F.abs(square("left") - square("right"))).alias("q"))
    gap = sum(((1.0 if a == b else 2.0) * F.pow(of(f"s_{a}_{b}", "left") - of(f"s_{a}_{b}", "right"), 2) for a in fx for b in fx if a <= b), F.lit(0.0))
    return run.select("series_id", "t", (F.sqrt(weight()) * F.sqrt(gap)).alias("q"))


def order2_information_scan(df: DataFrame, features: tuple[Sequence[float], Sequence[float], Sequence[float], Sequence[float]], w: int) -> DataFrame:
    """sqrt(weight) |I_L - I_R| with order-2 entropies (-log of the sum of squared moments): the eigenvalue-free sibling of the information scan."""
    rows, fx, fy = _unit_features(rank_units(df), features)
    half = lambda f: [(a, b) for i, a in enumerate(f) for b in f[i:]]
    px, py = half(fx), half(fy)
    sums = {f"x_{a}_{b}": f"{a} * {b}" for a, b in px} | {f"y_{a}_{b}": f"{a} * {b}" for a, b in py}
    sums |= {f"j_{a}_{b}_{c}_{e}": f"{a} * {b} * {c} * {e}" for a, b in px for c, e in py}
    run = on_grid(accumulated(rows.select("series_id", "t", "n", *fx, *fy), sums), w)
    left, right = d("t"), d("n") - d("t")
    of = lambda c, part: F.col(c) / left if part == "left" else (F.col(f"{c}_all") - F.col(c)) / right
    times = lambda *p: float(2 ** sum(a != b for a, b in p))

    def info(part: str) -> Column:
        x = sum((times((a, b)) * F.pow(of(f"x_{a}_{b}", part), 2) for a, b in px), F.lit(0.0))
        y = sum((times((a, b)) * F.pow(of(f"y_{a}_{b}", part), 2) for a, b in py), F.lit(0.0))
        j = sum((times((a, b), (c, e)) * F.pow(of(f"j_{a}_{b}_{c}_{e}", part), 2) for a, b in px for c, e in py), F.lit(0.0))
        return F.log(j) - F.log(x) - F.log(y)

    return run.select("series_id", "t", (F.sqrt(weight()) * F.abs(info("left") - info("right"))).alias("q"))


def vector_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows (block_id, t, n, arrays x and y) as one series per pair of coordinates; series_id names block and pair."""
    one = df.select("block_id", "t", "n", F.posexplode(x).alias("i", "x"), F.col(y).alias("_y"))
    both = one.select("block_id", "t", "n", "i", "x", F.posexplode("_y").alias("j", "y"))
    return both.select("block_id", F.concat_ws("/", "block_id", "i", "j").alias("series_id"), "t", "n", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def vector_spearman_scan(df: DataFrame, x: str, y: str, w: int = 60) -> DataFrame:
    """(series_id, t, q) of vector blocks: the mean over all pairs of coordinates."""
    curves = spearman_scan(vector_pairs(df, x, y).drop("block_id"), w)
    return curves.groupBy(F.substring_index("series_id", "/", 1).alias("series_id"), "t").agg(F.avg("q").alias("q"))
