"""Verdicts, rates, distances between segmentations, multiplicity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Share and its binomial standard error."""
    p = F.avg(F.col(flag).cast("double"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), p.alias("rate"), F.sqrt(p * (1 - p) / F.count("*")).alias("se"))


def best_form(df: DataFrame, keys: Sequence[str], mode: str, value: str) -> DataFrame:
    """The mode with the largest value, the smallest mode on ties."""
    return df.groupBy(*keys).agg(F.max_by(mode, F.struct(F.round(value, 9), -F.col(mode))).alias("best_mode"), F.max(value).alias("best"))


def reaches(a: Column, b: Column) -> Column:
    """a >= b, up to rounding."""
    return a >= b - F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(b))


def studentized_maxima(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, replica, t_max, tau_hat): curves (keys, replica, t, q) less their mean over replicas, the observed 0 among them, over the
    population deviation + 1e-12, and the largest value with its first position."""
    at = Window.partitionBy(*keys, "t")
    z = curves.withColumn("z", (F.col("q") - F.avg("q").over(at)) / (F.stddev_pop("q").over(at) + F.lit(1e-12)))
    return z.groupBy(*keys, "replica").agg(F.max("z").alias("t_max"), F.max_by("t", F.struct(F.round("z", 9), -F.col("t"))).alias("tau_hat"))


def permutation_p(maxima: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(1 + replicas that reach the observed maximum) / (K + 1)."""
    seen = maxima.filter("replica = 0").select(*keys, F.col("t_max").alias("observed"), F.col("tau_hat").alias("tau"))
    both = maxima.filter("replica > 0").join(F.broadcast(seen) if not keys else seen, list(keys))
    return both.groupBy(*keys, "observed", "tau").agg(((1 + F.count_if(reaches(F.col("t_max"), F.col("observed")))) / (F.count("*") + 1)).alias("p"))


def quantile_decision(maxima: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """Whether the observed maximum exceeds the replicas' quantile."""
    seen = maxima.filter("replica = 0").select(*keys, F.col("t_max").alias("observed"))
    cut = maxima.filter("replica > 0").groupBy(*keys).agg(F.percentile("t_max", F.lit(1 - alpha)).alias("threshold"))
    return seen.join(cut, list(keys)).withColumn("rejects", F.col("observed") > F.col("threshold"))


def null_thresholds(curves: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """Monte Carlo calibration from null curves (keys, rep, t, q): the raw threshold from all, the studentized one from the second
    half of the replicates with the first half's moments."""
    reps = curves.groupBy(*keys).agg(F.countDistinct("rep").alias("_reps"))
    c = curves.join(reps, list(keys))
    raw = c.groupBy(*keys, "rep").agg(F.max("q").alias("m")).groupBy(*keys).agg(F.percentile("m", F.lit(1 - alpha)).alias("raw"))
    half = F.col("rep") < F.floor(F.col("_reps") / 2)
    moments = c.filter(half).groupBy(*keys, "t").agg(F.avg("q").alias("mu"), F.stddev_pop("q").alias("sd"))
    z = c.filter(~half).join(moments, [*keys, "t"]).withColumn("z", (F.col("q") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    std = z.groupBy(*keys, "rep").agg(F.max("z").alias("m")).groupBy(*keys).agg(F.percentile("m", F.lit(1 - alpha)).alias("studentized"))
    return raw.join(std, list(keys))


def verdicts(curves: DataFrame, keys: Sequence[str], thresholds: DataFrame, on: Sequence[str], tau: int, tol: int) -> DataFrame:
    """Per replicate: maximum, its first place, detection, and detection within `tol` of tau."""
    top = curves.groupBy(*keys).agg(F.max("q").alias("max"), F.max_by("t", F.struct(F.round("q", 9), -F.col("t"))).alias("tau_hat")).join(thresholds, list(on))
    found = F.col("max") > F.col("threshold")
    gap = F.abs(F.col("tau_hat") - F.lit(tau))
    return top.withColumns({"detected": found, "power_hit": found & (gap <= tol), "loc_err": F.when(found, gap)})


def power_summary(v: DataFrame, keys: Sequence[str]) -> DataFrame:
    return v.groupBy(*keys).agg(F.avg(F.col("power_hit").cast("double")).alias("power"), F.avg(F.col("detected").cast("double")).alias("detect_rate"), F.median("loc_err").alias("loc_err_median"), F.count("*").alias("n_reps"))


def hausdorff(df: DataFrame, true: str, est: str, n: str) -> DataFrame:
    """The distance of two arrays of change points per row: 0 if both are empty, n if one is."""
    far = lambda a, b: F.array_max(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.abs(x - y)))))
    a, b = F.col(true), F.col(est)
    d = F.when((F.size(a) == 0) & (F.size(b) == 0), 0).when((F.size(a) == 0) | (F.size(b) == 0), F.col(n)).otherwise(F.greatest(far(a, b), far(b, a)))
    return df.withColumn("hausdorff", d.cast("double"))


def adjusted_rand(labels: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Agreement of two labelings of the rows beyond chance; 1 where chance leaves no room."""
    cells = labels.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    two = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2.0
    side = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two("n")).alias(name), F.sum("n").alias(f"n_{name}"))
    all_ = cells.groupBy(*keys).agg(F.sum(two("n")).alias("sij")).join(side(a, "si"), list(keys)).join(side(b, "sj"), list(keys))
    chance = F.col("si") * F.col("sj") / two("n_si")
    top = 0.5 * (F.col("si") + F.col("sj"))
    return all_.select(*keys, F.when(top != chance, (F.col("sij") - chance) / (top - chance)).otherwise(1.0).alias("ari"))


def recall_precision(df: DataFrame, true: str, est: str, delta: int) -> DataFrame:
    """Shares of true points with an estimate within delta, and the other way round; whether all agree in number and place."""
    hit = lambda a, b: F.size(F.filter(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= delta)))
    t, e = F.col(true), F.col(est)
    return df.withColumns({"recall": F.when(F.size(t) > 0, hit(t, e) / F.size(t)), "precision": F.when(F.size(e) > 0, hit(e, t) / F.size(e)), "exact": (F.size(t) == F.size(e)) & (hit(t, e) == F.size(t))})


def step_up_q(df: DataFrame, keys: Sequence[str], p: str, name: str, dependent: bool = False) -> DataFrame:
    """Step-up q-values; `dependent` multiplies by the harmonic number of the family's size."""
    order = Window.partitionBy(*keys).orderBy(p)
    every = Window.partitionBy(*keys)
    rank, m = F.row_number().over(order), F.count("*").over(every)
    ranked = df.withColumns({"_k": rank, "_m": m})
    harmonic = F.sum(1.0 / F.col("_k")).over(every) if dependent else F.lit(1.0)
    # from the largest p down: a frame that ends with the partition would be summed up anew for each row
    tail = Window.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("_q", F.col(p) * F.col("_m") * harmonic / F.col("_k")).withColumn(name, F.least(F.lit(1.0), F.min("_q").over(tail))).drop("_k", "_m", "_q")


def holm(df: DataFrame, keys: Sequence[str], p: str, name: str) -> DataFrame:
    """Step-down adjusted p-values."""
    ranked = df.withColumns({"_k": F.row_number().over(Window.partitionBy(*keys).orderBy(p)), "_m": F.count("*").over(Window.partitionBy(*keys))})
    head = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(name, F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_k") + 1) * F.col(p))).over(head)).drop("_k", "_m")


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p-value of discordant counts: twice the binomial tail at one half, terms by their ratio."""
    n, k = b + c, F.least(b, c)
    step = lambda a, i: F.struct((a["term"] * (n - i + 1) / i).alias("term"), (a["sum"] + a["term"] * (n - i + 1) / i).alias("sum"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step, lambda a: a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * tail / F.pow(F.lit(2.0), n)))


def ks_two_sample(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """The largest difference of the two groups' distribution functions (group: 0 or 1)."""
    size = df.groupBy(*keys).agg(F.count_if(F.col(group) == 0).alias("_n0"), F.count_if(F.col(group) == 1).alias("_n1"))
    points = df.groupBy(*keys, value).agg(F.count_if(F.col(group) == 0).alias("_a"), F.count_if(F.col(group) == 1).alias("_b"))
    to = Window.partitionBy(*keys).orderBy(value)
    run = points.withColumns({"_ca": F.sum("_a").over(to), "_cb": F.sum("_b").over(to)}).join(size, list(keys))
    return run.groupBy(*keys).agg(F.max(F.abs(F.col("_ca") / F.col("_n0") - F.col("_cb") / F.col("_n1"))).alias("ks"))


def classified(df: DataFrame, q: str, marginal: str, labels: tuple[str, str, str, str], q_at: float = 0.10, p_at: float = 0.05) -> DataFrame:
    """Four classes: dependence alone, both, marginal alone, neither (labels in that order)."""
    dep, marg = F.col(q) <= q_at, F.col(marginal) <= p_at
    return df.withColumn("cls", F.when(dep & ~marg, labels[0]).when(dep & marg, labels[1]).when(marg, labels[2]).otherwise(labels[3]))


def distribution_summary(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), *(F.percentile(value, F.lit(p)).alias(f"q{round(100 * p):02d}") for p in levels))


def split_gains(cost: DataFrame) -> DataFrame:
    """C(i,j) - C(i,t) - C(t,j) for all i < t < j of cost rows (series_id, i, j, c). Triples are shuffled: for few cells, see `segment.gauss_split_gains`."""
    a = cost.select("series_id", "i", F.col("j").alias("t"), F.col("c").alias("c1"))
    b = cost.select("series_id", F.col("i").alias("t"), "j", F.col("c").alias("c2"))
    return a.join(b, ["series_id", "t"]).join(cost, ["series_id", "i", "j"]).select("series_id", "i", "t", "j", (F.col("c") - F.col("c1") - F.col("c2")).alias("gain"))


def bonferroni_threshold(nulls: DataFrame, keys: Sequence[str], coordinates: int, alpha: float) -> DataFrame:
    """The null quantile at 1 - alpha / d of values pooled over coordinates."""
    return nulls.groupBy(*keys).agg(F.percentile("q", F.lit(1 - alpha / coordinates)).alias("threshold"))
