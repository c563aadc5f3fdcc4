"""Scans, tests and segmentations that need eigenvalues or optimisers: grouped Arrow functions, one task per series, interval or replica chunk."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import detection as dt
from tidewatch.functions import spectra as sp
from tidewatch.operators import tiles
from tidewatch.operators.ranks import pseudo_observations

KEY = "series_id"


def by_series(df: DataFrame, make: Callable[[np.ndarray, np.ndarray], dict[str, Any]], schema: str, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """One call per group with its x and y in order of t; what it returns (columns of equal length, or scalars) are the group's rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        found = make(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        size = max((len(v) for v in found.values() if isinstance(v, (list, np.ndarray))), default=1)
        if not size:
            return pd.DataFrame()  # an empty text column can't be handed over
        rows = {k: v if isinstance(v, (list, np.ndarray)) else [v] * size for k, v in found.items()}
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * size for k in keys}, **rows})

    return df.select(*keys, "t", "x", "y").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + schema)


def curve(df: DataFrame, make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], grid: Callable[[int], np.ndarray] = sp.fraction_grid) -> DataFrame:
    """(series_id, t, q) of a curve over the grid."""

    def one(x: np.ndarray, y: np.ndarray) -> dict[str, Any]:
        t = grid(len(x))
        return {"t": t.astype(np.int64), "q": make(x, y, t)}

    return by_series(df, one, "t long, q double")


# ---- one long series over many tasks: ranks in Spark, moments per interval, then a few hundred small matrices


def ranked_intervals(df: DataFrame, unit: int | None = None, pieces: int = 160, seed: int = dt.SEED, ranges: int | None = None) -> DataFrame:
    """(series_id, interval, t, x, y, gx, gy): whole-series ranks with the bandwidths of both sides, by run of `unit` rows, or by one of so
    many equal pieces of each series, whatever its length.

    Ranks are windows, of long series in ranges of about `ranges` rows; the bandwidths come from the 400 rows that seed and length choose.
    """
    u = pseudo_observations(df, [KEY], "t", ["x", "y"], ranges=ranges).select(KEY, "t", "n", F.col("x_u").alias("x"), F.col("y_u").alias("y"))

    def chosen(batches):
        for pdf in batches:
            out = []
            for s, n in zip(pdf[KEY], pdf["n"]):
                for side, k in (("x", 0), ("y", 1)):
                    rows = np.random.default_rng(seed + k + 1).choice(n, size=min(n, 400), replace=False) + 1
                    out.append(pd.DataFrame({KEY: s, "side": side, "t": rows.astype(np.int64)}))
            yield pd.concat(out) if out else pd.DataFrame({KEY: [], "side": [], "t": []})

    kind = df.schema[KEY].dataType.simpleString()
    picked = u.filter("t = n").select(KEY, "n").mapInPandas(chosen, f"{KEY} {kind}, side string, t long")
    values = picked.join(u, [KEY, "t"]).select(KEY, "side", F.when(F.col("side") == "x", F.col("x")).otherwise(F.col("y")).alias("v"))

    def width(pdf: pd.DataFrame) -> pd.DataFrame:
        med = sp.median_square_distance(pdf["v"].to_numpy()[:, None])
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "side": [pdf["side"].iloc[0]], "gamma": [1 / (med if med > 0 else 1.0)]})

    gammas = values.groupBy(KEY, "side").applyInPandas(width, f"{KEY} {kind}, side string, gamma double").groupBy(KEY).agg(F.max(F.when(F.col("side") == "x", F.col("gamma"))).alias("gx"), F.max(F.when(F.col("side") == "y", F.col("gamma"))).alias("gy"))
    place = F.floor((F.col("t") - 1) / unit) if unit else F.floor((F.col("t") - 1) * pieces / F.col("n"))
    return u.withColumn("interval", place.cast("long")).join(gammas, KEY).select(KEY, "interval", "t", "x", "y", "gx", "gy")


def interval_moments(df: DataFrame, unit: int | None = None, pieces: int = 160, size: int = dt.DIM, seed: int = dt.SEED, ranges: int | None = None) -> DataFrame:
    """(series_id, interval, cnt, mx, my, mj): moment sums of the features of whole-series ranks per interval.

    Each interval is a task's matrix product, so no series has to fit into one task (its ranks neither, with `ranges`) and 4,096 products per
    row are never rows.
    """
    rows, kind = ranked_intervals(df, unit, pieces, seed, ranges), df.schema[KEY].dataType.simpleString()

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        fx = sp.features(pdf["x"].to_numpy()[:, None], size, seed, pdf["gx"].iloc[0])
        fy = sp.features(pdf["y"].to_numpy()[:, None], size, seed + 1, pdf["gy"].iloc[0])
        j = sp.products(fx, fy)
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "interval": [pdf["interval"].iloc[0]], "cnt": [len(pdf)], **{k: [(f.T @ f).ravel()] for k, f in (("mx", fx), ("my", fy), ("mj", j))}})

    arrays = "mx array<double>, my array<double>, mj array<double>"
    return rows.select(KEY, "interval", "x", "y", "gx", "gy").groupBy(KEY, "interval").applyInPandas(moments, f"{KEY} {kind}, interval long, cnt long, {arrays}")


def _stacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("interval")
    square = lambda c: (lambda m: m.reshape(len(m), int(m.shape[1] ** 0.5), -1))(np.stack(pdf[c].to_numpy()))
    return square("mx"), square("my"), square("mj"), pdf["cnt"].to_numpy()


def moment_curve(moments: DataFrame, lo: int = 3) -> DataFrame:
    """(series_id, interval, q): the weighted difference of information at interval edges, from moment sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mx, my, mj, cnt = _stacked(pdf)
        grid = np.arange(lo, len(cnt) - lo + 1)
        if not len(grid):
            return pd.DataFrame({KEY: [], "interval": [], "q": []})
        c = np.cumsum(cnt)
        sums = [np.cumsum(m, axis=0) for m in (mx, my, mj)]
        left = sp.mutual_information(*(s[grid - 1] for s in sums), sp.ent14, floor=False)
        right = sp.mutual_information(*(s[-1] - s[grid - 1] for s in sums), sp.ent14, floor=False)
        at, n = c[grid - 1], c[-1]
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "interval": grid.astype(np.int64), "q": np.sqrt(at * (n - at) / n) * np.abs(left - right)})

    return moments.groupBy(KEY).applyInPandas(run, f"{KEY} {moments.schema[KEY].dataType.simpleString()}, interval long, q double")


def moment_test(moments: DataFrame, replicas: int, chunks: int, seed: int, block: int = 1, lo: int = 3, strata: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(series_id, observed, tau, p): permutations of intervals (in blocks, within strata of the interval number) in chunks of replicas.

    Pass 1 gives each chunk's curves; studentizing and the count are aggregates over all replicas (the observed one is replica 0).
    """
    kind = moments.schema[KEY].dataType.simpleString()
    spread = moments.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mx, my, mj, cnt = _stacked(pdf)
        chunk, b = int(pdf["chunk"].iloc[0]), len(cnt)
        grid = np.arange(lo, b - lo + 1)
        out = []
        for k in range(chunk, replicas + 1, chunks):
            rng = np.random.default_rng([seed, k])
            o = np.arange(b) if k == 0 else dt.block_order(b, block, rng) if strata is None else dt.stratified_block_order(b, block, strata(np.arange(b // block)), rng)
            c = np.cumsum(cnt[o])
            sums = [np.cumsum(m[o], axis=0) for m in (mx, my, mj)]
            left = sp.mutual_information(*(s[grid - 1] for s in sums), sp.ent14, floor=False)
            right = sp.mutual_information(*(s[-1] - s[grid - 1] for s in sums), sp.ent14, floor=False)
            at = c[grid - 1]
            out.append(pd.DataFrame({KEY: pdf[KEY].iloc[0], "replica": k, "t": grid.astype(np.int64), "q": np.sqrt(at * (c[-1] - at) / c[-1]) * np.abs(left - right)}))
        return pd.concat(out) if out else pd.DataFrame({KEY: [], "replica": [], "t": [], "q": []})

    from tidewatch.operators.evaluate import permutation_p, studentized_maxima

    curves = spread.groupBy(KEY, "chunk").applyInPandas(run, f"{KEY} {kind}, replica long, t long, q double")
    return permutation_p(studentized_maxima(curves, [KEY]), [KEY])


def dense_curve(df: DataFrame, w: int = 60, pieces: int = 160, size: int = dt.DIM, seed: int = dt.SEED, ranges: int | None = None) -> DataFrame:
    """(series_id, t, q): the weighted difference of information at every split w <= t <= n - w.

    An interval's task starts from the moments in front of it and adds its own rows one by one, so a long series is as many tasks as pieces.
    """
    rows, kind = ranked_intervals(df, None, pieces, seed, ranges), df.schema[KEY].dataType.simpleString()

    def ahead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("interval")
        out = {KEY: pdf[KEY], "interval": pdf["interval"], "n": pdf["cnt"].sum()}
        for c in ("mx", "my", "mj"):
            sums = np.cumsum(np.stack(pdf[c].to_numpy()), axis=0)
            out |= {c: list(np.concatenate([np.zeros_like(sums[:1]), sums[:-1]])), f"{c}_all": [sums[-1]] * len(pdf)}
        return pd.DataFrame(out)

    arrays = ", ".join(f"{c} array<double>, {c}_all array<double>" for c in ("mx", "my", "mj"))
    before = interval_moments(df, None, pieces, size, seed, ranges).groupBy(KEY).applyInPandas(ahead, f"{KEY} {kind}, interval long, n long, {arrays}")

    def run(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own, first = own.sort_values("t"), start.iloc[0]
        t, n = own["t"].to_numpy(), int(first["n"])
        fx = sp.features(own["x"].to_numpy()[:, None], size, seed, own["gx"].iloc[0])
        fy = sp.features(own["y"].to_numpy()[:, None], size, seed + 1, own["gy"].iloc[0])
        found = []
        for lo in range(0, len(t), 64):  # 64 rows' moments at a time
            sides = []
            for c, f in (("mx", fx), ("my", fy), ("mj", sp.products(fx, fy))):
                d = f.shape[1]
                f0, part = f[:lo], f[lo : lo + 64]
                left = np.reshape(first[c], (d, d)) + f0.T @ f0 + np.cumsum(part[:, :, None] * part[:, None, :], axis=0)
                sides.append((left, np.reshape(first[f"{c}_all"], (d, d)) - left))
            ok = (t[lo : lo + 64] >= w) & (t[lo : lo + 64] <= n - w)
            if ok.any():
                left, right = (sp.mutual_information(*(s[k][ok] for s in sides)) for k in (0, 1))
                at = t[lo : lo + 64][ok]
                found.append(pd.DataFrame({KEY: own[KEY].iloc[0], "t": at, "q": np.sqrt(at * (n - at) / n) * np.abs(left - right)}))
        return pd.concat(found) if found else pd.DataFrame()

    return rows.groupBy(KEY, "interval").cogroup(before.groupBy(KEY, "interval")).applyInPandas(run, f"{KEY} {kind}, t long, q double")


Shuffle = Callable[[np.ndarray, np.ndarray, int, np.random.Generator], tuple[np.ndarray, np.ndarray]]


def pairs_shuffled(x: np.ndarray, y: np.ndarray, block: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in another order, or blocks of pairs if `block` isn't 0 (a short last block stays last)."""
    o = dt.block_order(len(x), block, rng) if block else dt.pair_order(len(x), rng)
    return x[o], y[o]


def replica_curves(df: DataFrame, make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], replicas: int, chunks: int, seed: int, shuffled: Shuffle = pairs_shuffled, grid: Callable[[int], np.ndarray] = sp.fraction_grid) -> DataFrame:
    """(series_id, replica, t, q): the curve of each series (replica 0) and of its shuffled copies, rows (series_id, t, n, x, y and, if
    blocks are wanted, block). Each copy has a seed of its own, and a series' copies are dealt to `chunks` tasks."""
    blocks = df.groupBy(KEY).agg(F.max("block" if "block" in df.columns else F.lit(0)).cast("int").alias("block"))
    spread = tiles.columns(df, "xy").join(blocks, KEY).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kind = df.schema[KEY].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, block, out = np.array(pdf["x"].iloc[0]), np.array(pdf["y"].iloc[0]), int(pdf["block"].iloc[0]), []
        t = grid(len(x))
        for k in range(int(pdf["chunk"].iloc[0]), replicas + 1, chunks):
            a, b = (x, y) if k == 0 else shuffled(x, y, block, np.random.default_rng([seed, k]))
            out.append(pd.DataFrame({KEY: pdf[KEY].iloc[0], "replica": k, "t": t.astype(np.int64), "q": make(a, b, t)}))
        return pd.concat(out) if out and len(t) else pd.DataFrame()

    return spread.groupBy(KEY, "chunk").applyInPandas(run, f"{KEY} {kind}, replica long, t long, q double")


def permutation_test(df: DataFrame, make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], replicas: int, chunks: int, seed: int, shuffled: Shuffle = pairs_shuffled) -> DataFrame:
    """(series_id, t_max, tau, p): everything is made anew for each copy; studentizing and counting are aggregates over all copies."""
    from tidewatch.operators.evaluate import permutation_p, studentized_maxima

    found = permutation_p(studentized_maxima(replica_curves(df, make, replicas, chunks, seed, shuffled), [KEY]), [KEY])
    return found.withColumnRenamed("observed", "t_max")


def moment_costs(moments: DataFrame) -> DataFrame:
    """(series_id, i, j, c): trace times entropy of every run of intervals, from moment sums of the joint features."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, mj, cnt = _stacked(pdf)
        s = np.concatenate([np.zeros((1, *mj.shape[1:])), np.cumsum(mj, axis=0)])
        i, j = np.triu_indices(len(s), 1)
        parts = [(s[j[k : k + 512]] - s[i[k : k + 512]]) for k in range(0, len(i), 512)]
        c = np.concatenate([np.trace(m, axis1=1, axis2=2) * sp.vn_entropy(m) for m in parts])
        return pd.DataFrame({KEY: pdf[KEY].iloc[0], "i": i.astype(np.int64), "j": j.astype(np.int64), "c": c})

    return moments.groupBy(KEY).applyInPandas(run, f"{KEY} {moments.schema[KEY].dataType.simpleString()}, i long, j long, c double")


def replicates(spark, cells: Sequence[tuple[str, float, int]], reps: int, null: bool, base: int = 20260820) -> DataFrame:
    """(scen, level, level_idx, rep): one row per series to generate, dealt out over the cluster."""
    rows = spark.createDataFrame([(s, float(v), k) for s, v, k in cells], "scen string, level double, level_idx int")
    return rows.crossJoin(spark.range(reps).withColumnRenamed("id", "rep")).withColumn("is_null", F.lit(null)).withColumn("base", F.lit(base).cast("long")).repartition(F.col("scen"), F.col("level"), F.col("rep"))


def generated(reps: DataFrame, n: int = 600, tau: int = 300) -> DataFrame:
    """(scen, level, rep, is_null, t, x, y) of two-column scenarios."""
    from tidewatch.functions.generators import generate

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                z = generate(r.scen, r.level, r.rep, n, tau, bool(r.is_null), r.base, r.level_idx)
                yield pd.DataFrame({"scen": r.scen, "level": r.level, "rep": r.rep, "is_null": r.is_null, "t": np.arange(1, len(z) + 1), "x": z[:, 0], "y": z[:, 1]})

    return reps.mapInPandas(run, "scen string, level double, rep long, is_null boolean, t long, x double, y double")


def power_study(spark, cells: Sequence[tuple[str, float, int]], reps: int, make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], alpha: float = 0.05, tau: int = 300, tol: int = 30, w: int = 60, lowest: Sequence[tuple[str, float, int]] | None = None) -> DataFrame:
    """Monte Carlo power: curves of null and alternative replicates, the null's threshold, verdicts and their summary per cell.

    Thresholds come from each cell's own null; `lowest` names one cell a scenario instead whose null serves all its levels.
    """
    from tidewatch.operators.evaluate import power_summary, verdicts

    keys = ["scen", "level", "rep"]

    on = ["scen"] if lowest else ["scen", "level"]

    def curves(null: bool) -> DataFrame:
        own = lowest if null and lowest else cells
        one = lambda x, y: (lambda g: {"t": g.astype(np.int64), "q": make(x, y, g)})(dt.dense(len(x), w)[::10])
        return by_series(generated(replicates(spark, own, reps, null)), one, "t long, q double", keys)

    top = curves(True).groupBy(*keys).agg(F.max("q").alias("m")).groupBy(*on).agg(F.percentile("m", F.lit(1 - alpha)).alias("threshold"))
    return power_summary(verdicts(curves(False), keys, top, on, tau, tol), ["scen", "level"])


def random_dates(df: DataFrame, keys: Sequence[str], t: str, per: int, margin: int, seed: int) -> DataFrame:
    """So many positions per series, at least `margin` from its ends, by a hash of position and seed."""
    n = F.max(t).over(Window.partitionBy(*keys))
    rows = df.select(*keys, F.col(t).alias("at"), n.alias("_n")).filter((F.col("at") > margin) & (F.col("at") <= F.col("_n") - margin))
    key = F.xxhash64("at", F.lit(seed))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(key, "at"))).filter(F.col("_k") <= per).drop("_k", "_n")
