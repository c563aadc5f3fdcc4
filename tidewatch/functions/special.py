"""Distribution functions and small numerical tools on NumPy alone."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

normal_cdf = np.vectorize(NormalDist().cdf, otypes=[float])
normal_ppf = np.vectorize(NormalDist().inv_cdf, otypes=[float])


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * scale


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def student_cdf(t: float, nu: float) -> float:
    tail = 0.5 * beta_inc(nu / 2, 0.5, nu / (nu + t * t))
    return 1 - tail if t > 0 else tail


def binomial_sf(k: int, n: int, p: float) -> float:
    """P(X > k)."""
    return 1.0 if k < 0 else 0.0 if k >= n else beta_inc(k + 1, n - k, p)


def beta_ppf(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_inc(a, b, mid) < q else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """The exact confidence interval of a binomial share."""
    tail = (1 - level) / 2
    return (0.0 if k == 0 else beta_ppf(tail, k, n - k + 1)), (1.0 if k == n else beta_ppf(1 - tail, k + 1, n - k))


def ks_uniform_p(values: np.ndarray) -> float:
    """Kolmogorov's test of uniformity on [0, 1], by the limit law with Stephens' correction."""
    u, n = np.sort(values), len(values)
    d = max(np.max(np.arange(1, n + 1) / n - u), np.max(u - np.arange(n) / n))
    z = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    k = np.arange(1, 101)
    return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * (k * z) ** 2)), 0, 1))


def average_ranks(a: np.ndarray) -> np.ndarray:
    _, place, count = np.unique(a, return_inverse=True, return_counts=True)
    ends = np.cumsum(count)
    return (ends - (count - 1) / 2)[place]


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 400, tol: float = 1e-8) -> np.ndarray:
    """The downhill simplex search from a start with steps of 5 % (0.00025 at zero)."""
    n = len(start)
    points = [np.asarray(start, float)]
    for k in range(n):
        p = points[0].copy()
        p[k] = p[k] * 1.05 if p[k] else 0.00025
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tol and max(np.max(np.abs(p - points[0])) for p in points[1:]) < tol:
            break
        centre = np.mean(points[:-1], axis=0)
        at = lambda c: centre + c * (points[-1] - centre)  # noqa: E731, B023
        away = at(-1.0)
        fa = f(away)
        if fa < values[0]:
            far = at(-2.0)
            ff = f(far)
            points[-1], values[-1] = (far, ff) if ff < fa else (away, fa)
        elif fa < values[-2]:
            points[-1], values[-1] = away, fa
        else:
            near = at(-0.5) if fa < values[-1] else at(0.5)
            fn = f(near)
            if fn < min(fa, values[-1]):
                points[-1], values[-1] = near, fn
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    return points[int(np.argmin(values))]
