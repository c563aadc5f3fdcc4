"""Experiments as compositions of the operators: one DataFrame in, one table of findings out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import detection as dt
from tidewatch.functions import spectra as sp
from tidewatch.operators import detect, evaluate, segment
from tidewatch.functions.generators import BREAKS
from tidewatch.operators.ranks import correlation
from tidewatch.operators.series import alternating_split, segment_label

LABELS = ("dependence change", "both change", "marginal change", "no change")


def adaptive(df: DataFrame, replicas: int, chunks: int, seed: int, least: int = 1, diagnostic_seed: int = 0) -> DataFrame:
    """(series_id, block, t_max, tau, p): exchangeability decides between permutations of pairs and of blocks, then the test of one break."""

    def one(x: np.ndarray, y: np.ndarray) -> dict:
        e = dt.exchangeability(x, y, replicas=39, seed=diagnostic_seed)
        return {"block": min(max(e["length"], least), max(len(x) // 4, 1)) if e["block"] else 0}

    blocks = detect.by_series(df, one, "block int")
    make = lambda x, y, t: dt.information_curve(*sp.pair_features(x, y, dt.DIM, dt.SEED), t)
    tests = detect.permutation_test(df.join(blocks, "series_id"), make, replicas, chunks, seed)
    return blocks.join(tests, "series_id")


def panel(df: DataFrame, replicas: int, chunks: int, seed: int) -> DataFrame:
    """Series (series_id, t, x, y, n) to verdicts: exchangeability decides pair or block permutations, one test a series, q-values over
    the panel, and what the two segments look like."""
    tests = adaptive(df, replicas, chunks, seed, least=2, diagnostic_seed=seed).withColumn("family", F.lit(1))
    tests = evaluate.step_up_q(evaluate.step_up_q(tests, ["family"], "p", "q"), ["family"], "p", "q_dependent", True).drop("family")
    cut = df.join(tests.select("series_id", "tau"), "series_id").withColumn("late", F.col("t") > F.col("tau"))
    side = cut.groupBy("series_id").agg(*(correlation(F.when(c, F.col("x")), F.when(c, F.col("y"))).alias(n) for c, n in ((~F.col("late"), "r_before"), (F.col("late"), "r_after"))))
    return tests.join(side, "series_id")


def two_stage(df: DataFrame, pieces: int, beta: float, replicas: int, chunks: int, half: int, seed: int, tested: DataFrame | None = None) -> DataFrame:
    """Stage one: interval moments, state costs, optimal partition. Stage two: each candidate is tested again on the moments of its
    window, then q-values and, with the marginal scale tests, classes. Everything after the moments works on a few small rows a series.

    tested: other rows of the same series for stage two; the same rows if not given.
    """
    moments = detect.interval_moments(df, pieces=pieces)
    cuts = segment.optimal_partition(segment.cost_arrays(detect.moment_costs(moments)), F.lit(beta))
    at = cuts.select("series_id", F.explode("cuts").alias("cut"))
    if tested is not None:
        df, moments = tested, detect.interval_moments(tested, pieces=pieces)
    around = moments.join(at, "series_id").filter((F.col("interval") >= F.col("cut") - half) & (F.col("interval") < F.col("cut") + half))
    named = around.withColumn("series_id", F.concat_ws("@", "series_id", "cut"))
    tests = detect.moment_test(named.drop("cut"), replicas, chunks, seed).withColumn("family", F.lit(1))
    q = evaluate.step_up_q(tests, ["family"], "p", "q")
    rows = df.withColumn("interval", F.floor((F.col("t") - 1) * pieces / F.col("n")).cast("long")).join(at, "series_id")
    rows = rows.filter((F.col("interval") >= F.col("cut") - half) & (F.col("interval") < F.col("cut") + half)).withColumn("series_id", F.concat_ws("@", "series_id", "cut"))
    margins = lambda x, y: {"p_marginal": min(dt.scale_test(v, 2 * half, replicas, [seed, k])[2] for k, v in enumerate((x, y)))}
    out = q.join(detect.by_series(rows, margins, "p_marginal double"), "series_id")
    return evaluate.classified(out, "q", "p_marginal", LABELS).drop("family")


def split_halves(df: DataFrame, block: int, trim: int, pieces: int, beta: float, replicas: int, chunks: int, half: int, seed: int) -> DataFrame:
    """Candidates from the blocks of one half, tested on those of the other, both ways round (`chosen`: the half that chose)."""
    dealt = alternating_split(df.withColumn("_at", F.col("t") - 1), "_at", block, trim, ["series_id"])
    own = Window.partitionBy("series_id", "half")
    dealt = dealt.withColumns({"t": F.row_number().over(own.orderBy("_at")).cast("long"), "n": F.count("*").over(own)}).drop("_at")
    side = {h: dealt.filter(F.col("half") == h).drop("half") for h in "AB"}
    both = [two_stage(side[a], pieces, beta, replicas, chunks, half, seed, side[b]).withColumn("chosen", F.lit(a)) for a, b in ("AB", "BA")]
    return both[0].unionByName(both[1])


def statistics_study(spark: SparkSession, cells: Sequence[tuple[str, float, int]], reps: int, makes: dict[str, Callable]) -> DataFrame:
    """The power study of several statistics (method: curve of x, y and a grid) over the same replicates."""
    parts = [detect.power_study(spark, cells, reps, make).withColumn("method", F.lit(name)) for name, make in makes.items()]
    return reduce(DataFrame.unionByName, parts)


def segmentation_study(spark: SparkSession, levels: Sequence[tuple[float, int]], reps: int, methods: dict[str, Callable[[np.ndarray, np.ndarray], list[int]]], delta: int = 60) -> DataFrame:
    """Segmentations of the series with three breaks: how many breaks they find, how far off and how well the segments agree."""
    keys = ["scen", "level", "rep"]
    rows = detect.generated(detect.replicates(spark, [("P1", v, k) for v, k in levels], reps, False))

    def all_methods(x: np.ndarray, y: np.ndarray) -> dict:
        return {"method": list(methods), "cuts": [",".join(map(str, sorted(find(x, y)))) for find in methods.values()]}

    found = detect.by_series(rows, all_methods, "method string, cuts string", keys)
    cuts = F.filter(F.transform(F.split("cuts", ","), lambda c: c.try_cast("int")), lambda c: c.isNotNull())
    found = found.withColumns({"cuts": cuts, "true": F.array(*map(F.lit, BREAKS)), "n": F.lit(4 * BREAKS[0])})
    far = evaluate.recall_precision(evaluate.hausdorff(found, "true", "cuts", "n"), "true", "cuts", delta)
    places = rows.select(*keys, "t").join(found.select(*keys, "method", "true", "cuts"), keys)
    labels = places.select(*keys, "method", segment_label(F.col("t"), F.col("true")).alias("a"), segment_label(F.col("t"), F.col("cuts")).alias("b"))
    every = far.join(evaluate.adjusted_rand(labels, [*keys, "method"], "a", "b"), [*keys, "method"])
    found = F.size("cuts")
    return every.groupBy("level", "method").agg(F.count("*").alias("reps"), F.avg(found.cast("double")).alias("mean_k"), F.avg((found == len(BREAKS)).cast("double")).alias("k_correct"), F.median("hausdorff").alias("hausdorff_median"), F.avg("ari").alias("ari_mean"), F.avg("recall").alias("recall_mean"))


def best_over_cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of the best cell per key, marked."""
    w = Window.partitionBy(*keys)
    return df.withColumn("best", F.col(value) == F.max(value).over(w))
