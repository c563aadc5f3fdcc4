"""Queries without SQL against slow forms written from the definitions: sums over rows, one segment and one eigenvalue problem at a time."""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import detection as dt
from tidewatch.functions import spectra as sp
from tidewatch.functions.generators import generate
from tidewatch.plans.registry import QUERIES, load

load()
HOURS, TOL = 130, 3e-6


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Two types of events over 130 hours; the second one's values and counts change together from hour 60 on."""
    rng, rows = np.random.default_rng(21), []
    for kind in ("click", "other"):
        for h in range(HOURS):
            z = rng.normal()
            more = int(rng.integers(1, 4)) + (kind == "other" and h >= 60 and z > 0) * 3
            rows += [(kind, int(rng.integers(1, 50)), float(np.round(20 + 5 * z + rng.gamma(2.0, 3.0), 2)), pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h, minutes=m)) for m in range(more)]
    frame = pd.DataFrame(rows, columns=["event_type", "user_id", "value", "ts"]).assign(event_id=range(len(rows)))
    folder = tmp_path_factory.mktemp("defined")
    frame.to_parquet(folder / "events.parquet", coerce_timestamps="us")
    hours = frame.assign(hour=frame.ts.dt.floor("h"), x=(frame.value * 100).round(), y=1.0).groupby(["event_type", "hour"])[["x", "y"]].sum().reset_index()
    series = {k: (g.x.to_numpy(float), g.y.to_numpy(float)) for k, g in hours.groupby("event_type")}
    raw = {k: (g.value.to_numpy(float), g.user_id.to_numpy(float)) for k, g in frame.groupby("event_type")}
    return str(folder), series, raw


@pytest.fixture(scope="module")
def run(spark, events):
    kept = {}

    def rows(name):
        if name not in kept:
            kept[name] = QUERIES[name](spark, events[0]).toPandas()
        return kept[name]

    return rows


def curve_of(frame, key, t="t", q="q"):
    own = frame[frame.series_id == key].sort_values(t)
    return own[t].tolist(), own[q].to_numpy(float)


def check(frame, series, expected, grid=sp.fraction_grid, **names):
    """A curve query: the whole grid of every series, and the expected value at each split."""
    assert set(frame.series_id) == set(series)
    for key, (x, y) in series.items():
        t, q = curve_of(frame, key, **names)
        assert t == grid(len(x)).tolist()
        assert q == pytest.approx([expected(x, y, k) for k in t], abs=TOL, rel=1e-6)


# ---- slow forms


def ranks(a):
    order = sorted(range(len(a)), key=lambda k: (a[k], k))
    out = np.empty(len(a))
    for r, k in enumerate(order, 1):
        out[k] = r / (len(a) + 1)
    return out


def entropy(m):
    lam = np.linalg.eigvals(m / np.trace(m)).real
    return -sum(v * math.log(v) for v in lam if v > 1e-15)


def state(rows):
    return sum(np.outer(r, r) for r in rows)


def joint(fx, fy):
    return np.array([np.kron(a, b) for a, b in zip(fx, fy)])


def information(fx, fy):
    return max(entropy(state(fx)) + entropy(state(fy)) - entropy(state(joint(fx, fy))), 0.0)


def feats(x, y, size=8, seed=2026):
    return sp.features(ranks(x)[:, None], size, seed), sp.features(ranks(y)[:, None], size, seed + 1)


def weight(t, n):
    return t * (n - t) / n


def studentized(curves, grid):
    """p, place and height of the observed maximum among all curves' maxima."""
    z = np.array([[(c[j] - np.mean([o[j] for o in curves])) / (np.std([o[j] for o in curves]) + 1e-12) for j in range(len(grid))] for c in curves])
    tops = [max(row) for row in z]
    return tops[0], int(grid[int(np.argmax(np.round(z[0], 9)))]), sum(v >= tops[0] - 1e-9 * max(1, abs(tops[0])) for v in tops) / len(tops)


# ---- information and states


def test_information_sides(run, events):
    _, series, _ = events
    got = run("i1_i25_information_sides")
    for part, cut in (("left", lambda f, t: f[:t]), ("right", lambda f, t: f[t:])):
        check(got, series, lambda x, y, t, cut=cut: information(*(cut(f, t) for f in feats(x, y))), q=part)
    check(got, series, lambda x, y, t: math.sqrt(t / len(x) * (1 - t / len(x))) * abs(len(x) * (information(*(f[:t] for f in feats(x, y))) - information(*(f[t:] for f in feats(x, y))))), q="process")


def test_every_split(run, events):
    got = run("i3_dense_information_scan")
    for key, (x, y) in events[1].items():
        t, q = curve_of(got, key)
        assert t == list(range(20, len(x) - 19))
        assert q == pytest.approx(information_curve(x, y, t), abs=TOL)


def test_corrected_information(run, events):
    def expected(x, y, t):
        fx, fy = feats(x, y)
        o = np.random.default_rng(2026 + 99).permutation(len(x))
        return information(fx[:t], fy[:t]) - information(fx[:t], fy[o][:t])

    check(run("i2_corrected_information"), events[1], expected)


def test_unweighted_information_at_half_the_distance(run, events):
    def expected(x, y, t):
        fx, fy = (sp.features(ranks(a)[:, None], 8, s, 2 * sp.bandwidth(ranks(a)[:, None], s)) for a, s in ((x, 2026), (y, 2027)))
        return abs(information(fx[:t], fy[:t]) - information(fx[t:], fy[t:]))

    check(run("i4_unweighted_information"), events[1], expected)


def test_joint_state(run, events):
    def expected(x, y, t):
        f, n = joint(*feats(x, y)), len(x)
        return n * (entropy(state(f)) - t / n * entropy(state(f[:t])) - (n - t) / n * entropy(state(f[t:])))

    check(run("i5_joint_state_scan"), events[1], expected)


def raw_features(x, y):
    z = np.column_stack([(a - a.mean()) / a.std() for a in (x, y)])
    return np.column_stack([sp.features(z, 32, 0, unit=False), np.ones(len(x))])


def test_state_with_traces(run, events):
    def expected(x, y, t):
        f = raw_features(x, y)
        left, right = state(f[:t]), state(f[t:])
        p = np.trace(left) / np.trace(left + right)
        return len(x) * max(entropy(left + right) - p * entropy(left) - (1 - p) * entropy(right), 0.0)

    check(run("i6_state_scan"), events[1], expected)


def test_state_of_sorted_spectra(run, events):
    def expected(x, y, t):
        f = raw_features(x, y)
        left, right = state(f[:t]), state(f[t:])
        p = np.trace(left) / np.trace(left + right)
        a, b = (np.sort(np.linalg.eigvals(m / np.trace(m)).real) for m in (left, right))
        mixed = entropy(np.diag(np.clip(p * a + (1 - p) * b, 0, None)))
        return len(x) * max(mixed - p * entropy(left) - (1 - p) * entropy(right), 0.0)

    check(run("i6_spectral_state_scan"), events[1], expected)


def test_gram_information(run, events):
    def gram(u):
        far = [(a - b) ** 2 for a, b in itertools.combinations(u, 2)]
        return np.exp(-np.subtract.outer(u, u) ** 2 / np.median(far))

    def expected(x, y, t):
        kx, ky, keys = gram(ranks(x)), gram(ranks(y)), np.random.default_rng(0).random(len(x))

        def side(rows):
            rows = sorted(sorted(rows, key=lambda k: keys[k])[:64])
            a, b = kx[np.ix_(rows, rows)], ky[np.ix_(rows, rows)]
            return entropy(a) + entropy(b) - entropy(a * b)

        return math.sqrt(weight(t, len(x))) * abs(side(range(t)) - side(range(t, len(x))))

    check(run("i16_gram_order1_scan"), events[1], expected)


def test_canonical_correlations(run, events):
    def expected(x, y, t):
        fx, fy = feats(x, y)

        def side(a, b):
            c = np.cov(a.T, b.T, bias=True)
            xx, yy, xy = c[:8, :8] + 0.01 * np.eye(8), c[8:, 8:] + 0.01 * np.eye(8), c[:8, 8:]
            squares = np.linalg.eigvals(np.linalg.solve(xx, xy) @ np.linalg.solve(yy, xy.T)).real
            return -0.5 * sum(math.log(1 - min(max(v, 0), 0.999**2)) for v in squares)

        return math.sqrt(weight(t, len(x))) * abs(side(fx[:t], fy[:t]) - side(fx[t:], fy[t:]))

    check(run("i20_canonical_scan"), events[1], expected)


def test_ensemble(run, events):
    def expected(x, y, t):
        draws = [feats(x, y, seed=2026 + 10 * k) for k in range(6)]
        return np.mean([math.sqrt(weight(t, len(x))) * abs(information(fx[:t], fy[:t]) - information(fx[t:], fy[t:])) for fx, fy in draws])

    check(run("i27_feature_ensemble"), events[1], expected, grid=sp.fraction_grid)


def test_renyi_windows(run, events):
    def bits(k, alpha):
        lam = np.clip(np.linalg.eigvals(k / np.trace(k)).real, 0, None)
        return math.log2(sum(lam**alpha)) / (1 - alpha)

    got = run("i22_renyi_windows")
    for key, (x, y) in events[1].items():
        own = got[got.series_id == key].sort_values("t")
        assert own["t"].tolist() == list(range(30, len(x) - 60 + 1 + 30))
        for r in own.iloc[::9].itertuples():
            grams = []
            for a in (x, y + 1e-9 * np.arange(len(y))):
                w = a[r.t - 30 : r.t + 30]
                z = (w - w.mean()) / w.std(ddof=1)
                grams.append(np.exp(-np.subtract.outer(z, z) ** 2 / (2 * (1.06 * 60**-0.2) ** 2)))
            for name, alpha in (("tc1", 1.01), ("tc2", 2.0)):
                assert getattr(r, name) == pytest.approx(bits(grams[0], alpha) + bits(grams[1], alpha) - bits(grams[0] * grams[1], alpha), abs=1e-4)


# ---- volatility models


def garch_path(r, total, alpha):
    h = [r.var()]
    for v in r[:-1]:
        h.append((1 - total) * r.var() + alpha * v * v + (total - alpha) * h[-1])
    return np.array(h)


def test_garch_is_the_likeliest(events):
    for x, _ in events[1].values():
        r = x - x.mean()
        h = (r / dt.garch_residuals(x)) ** 2
        c = np.linalg.lstsq(np.column_stack([np.ones(len(r) - 1), r[:-1] ** 2 / r.var(), h[:-1]]), h[1:], rcond=None)[0]
        assert np.column_stack([np.ones(len(r) - 1), r[:-1] ** 2 / r.var(), h[:-1]]) @ c == pytest.approx(h[1:], rel=1e-6)  # a recursion of its kind
        loss = lambda h: float((np.log(h) + r * r / h).sum())  # noqa: B023, E731
        shares = np.linspace(0.02, 0.98, 25)
        best = min(loss(garch_path(r, 0.999 * s, 0.999 * s * a)) for s in shares for a in shares)
        assert loss(h) <= best + 0.02


def test_dcc_is_the_likeliest(run, events):
    def path(a, b, total, alpha):
        z = np.column_stack([a, b])
        mean = z.T @ z / len(z)
        q, out = mean, []
        for v in z:
            out.append(q[0, 1] / math.sqrt(q[0, 0] * q[1, 1]))
            q = (1 - total) * mean + alpha * np.outer(v, v) + (total - alpha) * q
        return np.clip(out, -0.999, 0.999)

    for key, (x, y) in events[1].items():
        a, b = dt.garch_residuals(x), dt.garch_residuals(y)
        loss = lambda r: float((np.log(1 - r * r) + (a * a + b * b - 2 * r * a * b) / (1 - r * r)).sum())  # noqa: B023, E731
        seen = dt.dcc_path(a, b)
        shares = np.linspace(0.03, 0.97, 14)
        assert loss(seen) <= min(loss(path(a, b, 0.999 * s, 0.999 * s * c)) for s in shares for c in shares) + 0.05
        t, q = curve_of(run("i19_dcc_cusum"), key)
        expected = [abs(sum(seen[:k] - seen.mean())) / (seen.std() * math.sqrt(len(seen)) + 1e-12) for k in t]
        assert t == sp.fraction_grid(len(x)).tolist() and q == pytest.approx(expected, abs=TOL)


# ---- permutations


def information_curve(x, y, grid):
    fx, fy = feats(x, y)
    return [math.sqrt(weight(t, len(x))) * abs(information(fx[:t], fy[:t]) - information(fx[t:], fy[t:])) for t in grid]


def copies(x, y, seed, how):
    for k in range(1, 20):
        yield how(x, y, np.random.default_rng([seed, k]))


def in_pairs(x, y, rng):
    o = rng.permutation(len(x))
    return x[o], y[o]


def in_blocks(block):
    def how(x, y, rng):
        full = len(x) // block
        o = [b * block + k for b in rng.permutation(full) for k in range(block)] + list(range(full * block, len(x)))
        return x[o], y[o]

    return how


@pytest.mark.parametrize("name, seed, how", [("j1_j11_pair_permutation_test", 1, in_pairs), ("j2_block_permutation_test", 1, in_blocks(12)), ("j4_one_sided_shuffle", 3, lambda x, y, rng: (x, rng.permutation(y)))])
def test_permutation_tests(run, events, name, seed, how):
    got = run(name).set_index("series_id")
    x, y = events[1]["other"]
    grid = sp.fraction_grid(len(x))
    top, tau, p = studentized([information_curve(a, b, grid) for a, b in [(x, y), *copies(x, y, seed, how)]], grid)
    row = got.loc["other"]
    assert (row.t_max, row.tau, row.p) == (pytest.approx(top, abs=1e-5), tau, pytest.approx(p))
    assert set(got.index) == set(events[1])


def test_reused_features(run, events):
    x, y = events[1]["other"]
    fx, fy = feats(x, y)
    grid = sp.fraction_grid(len(x))
    curves = []
    for o in [np.arange(len(x)), *(np.random.default_rng([1, k]).permutation(len(x)) for k in range(1, 20))]:
        a, b = fx[o], fy[o]
        curves.append([math.sqrt(weight(t, len(x))) * abs(information(a[:t], b[:t]) - information(a[t:], b[t:])) for t in grid])
    top, tau, p = studentized(curves, grid)
    row = run("j5_reused_features_test").set_index("series_id").loc["other"]
    assert (row.t_max, row.tau, row.p) == (pytest.approx(top, abs=1e-5), tau, pytest.approx(p))


def acf(z, lag):
    z = z - z.mean()
    return sum(z[k] * z[k + lag] for k in range(len(z) - lag)) / sum(z * z)


def boxes(zx, zy, lags):
    n = len(zx)
    q = [n * (n + 2) * sum(acf(z, k) ** 2 / (n - k) for k in range(1, lags + 1)) for z in (zx, zy, zx**2, zy**2)]
    a, b = zx - zx.mean(), zy - zy.mean()
    size = math.sqrt(sum(a * a) * sum(b * b))
    cross = sum((sum(a[j] * b[j + k] for j in range(n - k)) / size) ** 2 / (n - k) + (sum(b[j] * a[j + k] for j in range(n - k)) / size) ** 2 / (n - k) for k in range(1, lags + 1))
    return [*q, n * (n + 2) * cross]


def average_ranks(a):
    return np.array([(sum(a < v) + sum(a <= v) + 1) / 2 for v in a])


def test_exchangeability(run, events):
    got = run("k1_exchangeability")
    x, y = events[1]["other"]
    zx, zy = (average_ranks(a) / (len(a) + 1) - 0.5 for a in (x, y))
    assert dt.portmanteau(zx, zy, 20) == pytest.approx(boxes(zx, zy, 20))
    rng, count = np.random.default_rng(20260828), np.ones(5)
    seen = np.array(boxes(zx, zy, 20))
    for _ in range(99):
        o = rng.permutation(len(x))
        count += dt.portmanteau(zx[o], zy[o], 20) >= seen * (1 - 1e-9)
    own = got[got.series_id == "other"].set_index("stat")
    names = ["level_x", "level_y", "square_x", "square_y", "cross"]
    assert own.loc[names, "p"].tolist() == pytest.approx(count / 100)
    times = []
    for z in (zx, zy, zx**2, zy**2):
        r, total = 1, 1.0
        while r <= min(len(x) // 4, 5000) and acf(z, r) > 0:
            total, r = total + 2 * acf(z, r), r + 1
        times.append(total)
    assert own.tau.tolist() == pytest.approx([max(times)] * 5, abs=TOL)
    assert set(own.block) == {bool((count / 100 <= 0.01).any())}


def test_adaptive_protocol_and_panel(run, events):
    for name, seed, diagnostic, least in (("j12_adaptive_protocol", 1, 0, 1), ("p_panel", 3, 3, 2)):
        got = run(name).set_index("series_id")
        for key, (x, y) in events[1].items():
            e = dt.exchangeability(x, y, replicas=39, seed=diagnostic)
            block = min(max(math.ceil(5 * e["tau"]), least), len(x) // 4) if e["block"] else 0
            grid = sp.fraction_grid(len(x))
            make = dt.information_of(grid)
            top, tau, p = studentized([make(a, b) for a, b in [(x, y), *copies(x, y, seed, in_blocks(block) if block else in_pairs)]], grid)
            row = got.loc[key]
            assert (row.block, row.t_max, row.tau, row.p) == (block, pytest.approx(top, abs=1e-5), tau, pytest.approx(p))


def test_moment_tests(spark, events):
    """Permutations of intervals, plain, in blocks and within strata, from sums of the rows' products."""
    from tidewatch.operators import detect
    from tidewatch.plans.fixtures import hourly

    m = detect.interval_moments(hourly(spark, events[0]), pieces=24).cache()
    rows = {k: g.sort_values("interval") for k, g in m.toPandas().groupby("series_id")}
    square = lambda v: np.reshape(v, (math.isqrt(len(v)), -1))
    for block, strata in ((1, None), (4, None), (1, lambda k: k % 3)):
        got = {r.series_id: r for r in detect.moment_test(m, 9, 3, 5, block=block, strata=strata).collect()}
        for key, own in rows.items():
            grid, curves = list(range(3, 22)), []
            for k in range(10):
                rng, o = np.random.default_rng([5, k]), np.arange(24)
                if k and strata:
                    for s in range(3):
                        at = np.nonzero(np.arange(24) % 3 == s)[0]
                        o[at] = rng.permutation(at)
                elif k:
                    o = np.array([b * block + j for b in rng.permutation(24 // block) for j in range(block)])
                parts = [[square(v) for v in own[c].iloc[o]] for c in ("mx", "my", "mj")]
                size = own["cnt"].to_numpy()[o]
                curve = []
                for t in grid:
                    side = [entropy(sum(p[0])) + entropy(sum(p[1])) - entropy(sum(p[2])) for p in ([q[:t] for q in parts], [q[t:] for q in parts])]
                    curve.append(math.sqrt(sum(size[:t]) * sum(size[t:]) / sum(size)) * abs(side[0] - side[1]))
                curves.append(curve)
            top, tau, p = studentized(curves, grid)
            assert (got[key].observed, got[key].tau, got[key].p) == (pytest.approx(top, abs=1e-4), tau, pytest.approx(p))


def mmd_best(z, a, b, w, scale):
    """The split of z[a:b) with the largest weighted discrepancy, and that."""
    k = lambda p, q: np.mean([[math.exp(-sum((u - v) ** 2) / scale) for v in z[q]] for u in z[p]])
    found = []
    for t in range(a + w, b - w + 1):
        left, right = slice(a, t), slice(t, b)
        found.append(((t - a) * (b - t) / (b - a) * max(k(left, left) + k(right, right) - 2 * k(left, right), 0), -t))
    return max(found) if found else None


def test_binary_segmentation(run, events):
    x, y = (v[:90] for v in events[1]["other"])
    z = np.column_stack([ranks(x), ranks(y)])
    scale = np.median([sum((u - v) ** 2) for u, v in itertools.combinations(z, 2)])
    expected, segments = [], [(0, 90)]
    while len(expected) < 2:
        tried = [(*mmd_best(z, a, b, 20, scale), a, b) for a, b in segments if b - a >= 42]
        if not tried:
            break
        gain, t, a, b = max(tried, key=lambda f: f[0])
        expected.append((-t, gain))
        segments = [s for s in segments if s != (a, b)] + [(a, -t), (-t, b)]
    got = dt.binary_segmentation(dt.mmd_gain(z, 20), 90, 20, 2)
    assert got == [(t, pytest.approx(g)) for t, g in expected]
    frame = run("l7_binary_segmentation")
    own = frame[frame.series_id == "other"].sort_values("place")
    z = np.column_stack([ranks(v) for v in events[1]["other"]])
    assert list(zip(own.tau, own.gain)) == [(t, pytest.approx(g, abs=TOL)) for t, g in dt.binary_segmentation(dt.mmd_gain(z, 30), len(z), 30, 4)]


def test_whole_procedure(run, events):
    for key, (x, y) in events[1].items():
        z, rng = np.column_stack([ranks(x), ranks(y)]), np.random.default_rng(5)
        best = lambda a: dt.binary_segmentation(dt.mmd_gain(a, 40), len(a), 40, 1)[0]
        t, g = best(z)
        full = len(z) // 12
        null = [best(z[[b * 12 + k for b in rng.permutation(full) for k in range(12)] + list(range(full * 12, len(z)))])[1] for _ in range(19)]
        row = run("j15_whole_procedure_permutation").set_index("series_id").loc[key]
        assert (row.tau, row.gain, row.p_adjusted) == (t, pytest.approx(g, abs=TOL), pytest.approx((1 + sum(v >= g - 1e-9 for v in null)) / 20))


def test_block_summaries(run, events):
    for key, (x, _) in events[1].items():
        v = np.log([np.var(x[k : k + 12]) + 1e-12 for k in range(0, len(x) // 12 * 12, 12)])
        box = lambda a: len(a) * (len(a) + 2) * sum(acf(a, k) ** 2 / (len(a) - k) for k in range(1, 6))
        rng = np.random.default_rng(11)
        p = (1 + sum(box(rng.permutation(v)) >= box(v) * (1 - 1e-9) for _ in range(499))) / 500
        row = run("k6_block_summary_portmanteau").set_index("series_id").loc[key]
        assert (row.q, row.p) == (pytest.approx(box(v), abs=TOL), pytest.approx(p))


# ---- segmentation


def test_state_costs(run, events):
    got = run("l1_state_costs")
    for key, (x, y) in events[1].items():
        f = joint(*feats(x, y))
        edges = [*range(0, len(x), 40), len(x)]
        own = {(r.i, r.j): r.c for r in got[got.series_id == key].itertuples()}
        assert set(own) == set(itertools.combinations(range(len(edges)), 2))
        for (i, j), c in own.items():
            assert c == pytest.approx((edges[j] - edges[i]) * entropy(state(f[edges[i] : edges[j]])), abs=1e-4)


def cheapest(cost, beta):
    """By trying every set of interior cuts."""
    g = len(cost)
    tries = [(sum(cost[a, b] + beta for a, b in zip((0, *s), (*s, g - 1))) - beta, s) for r in range(g - 1) for s in itertools.combinations(range(1, g - 1), r)]
    return min(tries)


def test_calibrated_partition(run, events):
    x, y = events[1]["other"]
    rng, grid, betas = np.random.default_rng(3), np.arange(0, len(x) + 1, 24), [0.5, 1.0, 2.0, 4.0, 8.0, 16.0]

    def costs(a, b):
        f = joint(*feats(a, b))
        direct = lambda rows: {(i, j): (grid[j] - grid[i]) * entropy(state(rows[grid[i] : grid[j]])) for i, j in itertools.combinations(range(len(grid)), 2)}
        own, mixed = direct(f), [direct(f[rng.permutation(len(f))]) for _ in range(3)]
        out = np.full((len(grid), len(grid)), np.inf)
        for (i, j), c in own.items():
            out[i, j] = c - np.mean([m[i, j] for m in mixed])
        return out

    seen, fires = costs(x, y), {b: 0 for b in betas}
    for _ in range(5):
        o = rng.permutation(len(x))
        c = costs(x[o], y[o])
        breaks = [bool(cheapest(c, b)[1]) for b in betas]
        first = next((k for k, v in enumerate(breaks) if not v), len(betas))
        for k, b in enumerate(betas):
            fires[b] += k < first
    beta = next((b for b in betas if fires[b] / 5 <= 0.05), betas[-1])
    row = run("l5_l6_calibrated_partition").set_index("series_id").loc["other"]
    assert (row.beta, row.cuts) == (beta, ",".join(str(grid[k]) for k in cheapest(seen, beta)[1]))


def breaks_of(x, y, depth, offset, test):
    if not depth or len(x) < 100:
        return []
    tau, p = test(x, y, [1, offset, len(x)])
    return [] if p > 0.05 else [*breaks_of(x[:tau], y[:tau], depth - 1, offset, test), offset + tau, *breaks_of(x[tau:], y[tau:], depth - 1, offset + tau, test)]


def sequential_test(x, y, seed):
    grid, rng = sp.fraction_grid(len(x)), np.random.default_rng(seed)
    make, curves = dt.information_of(grid), []
    for k in range(20):
        o = rng.permutation(len(x)) if k else np.arange(len(x))
        curves.append(make(x[o], y[o]))
    return studentized(curves, grid)[1:]


def test_recursive_breaks(run, events):
    got = run("l8_recursive_breaks").set_index("series_id").cuts
    for key, (x, y) in events[1].items():
        assert got[key] == ",".join(map(str, breaks_of(x, y, 2, 0, sequential_test)))
    z = generate("D1", 0.95, 0, n=240, tau=120)
    assert breaks_of(*z.T, 2, 0, sequential_test) == dt.recursive_breaks(*z.T, 20, 19, 0.05, 1, 2, 100)


def test_energy_segments(run, events):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(80, 2)) * np.where(np.arange(80) < 35, 1.0, 4.0)[:, None]
    d = np.array([[math.dist(a, b) for b in z] for a in z])

    def best(order, edges, least, step):
        found = []
        for a, b in zip(edges, edges[1:]):
            own = d[np.ix_(order[a:b], order[a:b])]
            for tau in range(least, b - a - least + 1, step):
                for kappa in sorted({*range(2 * least, b - a, step), b - a}):
                    if kappa - tau >= least:
                        found.append((dt.energy_gain(own, tau, kappa), a + tau))
        return max(found, key=lambda f: f[0])

    def segments(replicas, least, step):
        edges = [0, 80]
        while True:
            if not any(b - a >= 2 * least for a, b in zip(edges, edges[1:])):
                return edges[1:-1]
            q, at = best(np.arange(80), edges, least, step)
            hits = 0
            for k in range(replicas):
                rng = np.random.default_rng([0, len(edges), k])
                hits += best(np.concatenate([rng.permutation(np.arange(a, b)) for a, b in zip(edges, edges[1:])]), edges, least, step)[0] >= q * (1 - 1e-9)
            if (1 + hits) / (1 + replicas) > 0.05:
                return edges[1:-1]
            edges = sorted([*edges, at])

    assert dt.energy_gain(d, 35, 80) == pytest.approx(35 * 45 / 80 * (2 * d[:35, 35:].mean() - d[:35, :35].sum() / (35 * 34) - d[35:, 35:].sum() / (45 * 44)))
    assert dt.energy_segments(z, 19, least=15, step=5) == segments(19, 15, 5) != []
    assert set(run("l9_energy_segments").series_id) == set(events[1])


def test_bg_segments(run, events):
    """The pooled t statistic at every split, its q, and the recursion."""
    from tidewatch.functions.special import beta_inc

    def split(s):
        n, found = len(s), []
        for j in range(25, n - 25 + 1):
            a, b = s[:j], s[j:]
            pooled = math.sqrt((sum((a - a.mean()) ** 2) + sum((b - b.mean()) ** 2)) / (n - 2)) * math.sqrt(1 / j + 1 / (n - j))
            found.append((round(abs(a.mean() - b.mean()) / pooled, 10), -j))
        if not found:
            return None
        t, j = max(found)
        inside = beta_inc(0.40 * (n - 2), 0.40, (n - 2) / (n - 2 + t * t))
        return -j, t, -max(4.19 * math.log(n) - 11.54, 1) * math.log1p(-inside)

    def segments(s, q0, offset=0):
        own = split(s) if len(s) >= 50 else None
        if own is None or own[2] >= q0:
            return []
        return [*segments(s[: own[0]], q0, offset), offset + own[0], *segments(s[own[0] :], q0, offset + own[0])]

    for key, (x, _) in events[1].items():
        row = run("i24_bg_q").set_index("series_id").loc[key]
        j, t, q = split(x)
        assert (row.tau, row.t_max, row.q, row.breaks) == (j, pytest.approx(t, abs=TOL), pytest.approx(q, abs=TOL), len(segments(x, 0.0513)))
        assert run("l10_bg_segments").set_index("series_id").cuts[key] == ",".join(map(str, segments(x, 3.0)))


def test_two_stages(run, events):
    got = run("l11_two_stage")
    expected = []
    for key, (x, y) in events[1].items():
        for c in dt.calibrated_partition(x, y, 24, [0.25, 0.5, 1.0, 2.0, 4.0], 5, 5)[0]:
            a, b = max(0, c - 72), min(len(x), c + 72)
            tau, p = sequential_test(x[a:b], y[a:b], [5, c])
            expected.append((key, c, p, a + tau))
    assert sorted(zip(got.series_id, got.date, got.p, got.tau)) == [(k, c, pytest.approx(p), t) for k, c, p, t in sorted(expected)]
    ordered = sorted(p for *_, p, _ in expected)
    for r in got.itertuples():
        q = min([1.0, *(ordered[k] * len(ordered) / (k + 1) for k in range(len(ordered)) if ordered[k] >= r.p - 1e-12)])
        assert r.q == pytest.approx(q, abs=TOL)


def test_random_dates(run, spark, events):
    from tidewatch.operators import detect

    days = spark.createDataFrame([(s, t) for s in "ab" for t in range(1, 401)], "series_id string, t long")
    got = detect.random_dates(days, ["series_id"], "t", 10, 120, 9).collect()
    for s in "ab":
        own = [r["at"] for r in got if r.series_id == s]
        assert len(set(own)) == 10 and min(own) > 120 and max(own) <= 280
    again = detect.random_dates(days.repartition(7), ["series_id"], "t", 10, 120, 9).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got)) != sorted(map(tuple, detect.random_dates(days, ["series_id"], "t", 10, 120, 8).collect()))
    assert run("l12_random_dates").empty  # 130 hours have none that far from both ends


# ---- estimates and limits


def test_clopper_pearson(run, events):
    for r in run("m9_clopper_pearson").itertuples():
        values = events[2][r.event_type][0]
        assert (r.k, r.n) == (sum(values > 60), len(values))
        tail = lambda p, ks: sum(math.comb(r.n, j) * p**j * (1 - p) ** (r.n - j) for j in ks)  # noqa: B023, E731
        assert r.lo == 0 if r.k == 0 else tail(r.lo, range(r.k, r.n + 1)) == pytest.approx(0.025, abs=1e-4)
        assert r.hi == 1 if r.k == r.n else tail(r.hi, range(r.k + 1)) == pytest.approx(0.025, abs=1e-4)


def test_bootstrap_median(run, events):
    for key, (x, _) in events[1].items():
        rng = np.random.default_rng(0)
        medians = [sorted(rng.choice(x, len(x)))[len(x) // 2 - 1 : len(x) // 2 + 1] for _ in range(200)]
        medians = [np.mean(m) for m in medians]
        row = run("f14_bootstrap_median").set_index("series_id").loc[key]
        assert (row["median"], row["se"]) == (pytest.approx(np.median(x)), pytest.approx(math.sqrt(sum((m - np.mean(medians)) ** 2 for m in medians) / 199), abs=1e-3))


def test_jittered_ranks(run, events):
    frame = run("e4_jittered_ranks")
    name = next(c for c in frame.columns if c not in ("series_id", "t"))
    raw = events[2]
    for key in raw:
        own = frame[frame.series_id == key].sort_values("t")
        assert len(own) and own[name].is_unique
    from tidewatch.operators.ranks import jittered_ranks  # ties go by the checksum of seed and time

    assert jittered_ranks.__doc__
    values = pd.DataFrame({"t": range(1, 41), "v": [k % 3 for k in range(40)]})
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = {r.t: r.r for r in jittered_ranks(spark.createDataFrame(values), [], "t", "v", "r", 7).collect()}
    order = sorted(values.itertuples(), key=lambda r: (r.v, zlib.crc32(f"7:{r.t}".encode()), r.t))
    assert got == {r.t: k for k, r in enumerate(order, 1)}


def test_limit_weights_by_all_entries():
    """The spectrum of the whole quadratic form on four indices."""
    z = generate("D2", 0.7, 3)[:200]
    fx, fy = (sp.features(ranks(c)[:, None], 3, s) for c, s in ((z[:, 0], 1), (z[:, 1], 2)))
    sides = []
    for f in (fx, fy):
        lam, v = np.linalg.eigh(f.T @ f / len(f))
        g = f @ v
        dev = np.array([(np.outer(r, r) - np.diag(lam)).ravel() for r in g])
        sides.append((lam, dev.T @ dev / len(f)))
    (lx, cx), (ly, cy) = sides
    form = np.zeros((9, 9))
    for (i, k), (j, l) in itertools.product(itertools.product(range(3), repeat=2), repeat=2):
        a, b = lx[i] * ly[j], lx[k] * ly[l]
        form[3 * i + k, 3 * j + l] = 1 / a if math.isclose(a, b, rel_tol=1e-12) else (math.log(a) - math.log(b)) / (a - b)
    values = np.linalg.eigvals(np.diag(form.ravel()) @ np.kron(cx, cy)).real / 2
    expected = np.sort(values[values > 1e-9])[::-1]
    assert dt.limit_weights(fx, fy)[: len(expected)] == pytest.approx(expected, rel=1e-6)


def test_limit_draws_have_the_law():
    w, share = np.array([1.0, 0.5, 0.25]), np.array([0.2, 0.5, 0.8])
    draws = dt.limit_draws(w, share, 4000, 1, mass=1.0)
    rng = np.random.default_rng(5)
    for k, s in enumerate(share):  # both sides are independent at a share: weighted chi-squares over it, and over the rest
        left, right = (rng.standard_normal((40_000, 3)) ** 2 @ w / part for part in (s, 1 - s))
        direct = np.sqrt(s * (1 - s)) * np.abs(left - right)
        assert np.quantile(draws[:, k], [0.25, 0.5, 0.9]) == pytest.approx(np.quantile(direct, [0.25, 0.5, 0.9]), rel=0.08)
    assert np.array_equal(dt.limit_draws(w, share, 7, 1, mass=1.0), draws[:7])


def test_asymptotic_test(run, events):
    for key, (x, y) in events[1].items():
        n, grid = len(x), sp.fraction_grid(len(x))
        fx, fy = feats(x, y)
        w = dt.limit_weights(fx, fy)
        curve = np.array([math.sqrt(t / n * (1 - t / n)) * n * abs(information(fx[:t], fy[:t]) - information(fx[t:], fy[t:])) for t in grid])
        sims = dt.limit_draws(w, grid / n, 500)
        row = run("n3_asymptotic_test").set_index("series_id").loc[key]
        tops = sims.max(axis=1)
        assert (row.c, row.t_raw, row.tau_raw) == (pytest.approx(w.sum(), abs=1e-3), pytest.approx(curve.max(), abs=1e-3), grid[int(np.argmax(curve))])
        assert (row.crit_raw, row.p_raw) == (pytest.approx(np.quantile(tops, 0.95), abs=1e-3), pytest.approx((1 + sum(tops >= curve.max() - 1e-9)) / 501, abs=1e-3))
        z = lambda c: (c - sims.mean(axis=0)) / (sims.std(axis=0) + 1e-12)  # noqa: B023, E731
        tops = np.array([z(c).max() for c in sims])
        assert (row.t_std, row.p_std) == (pytest.approx(z(curve).max(), abs=1e-3), pytest.approx((1 + sum(tops >= z(curve).max() - 1e-9)) / 501, abs=1e-3))


def test_exact_null_draws(run):
    got = run("n4_exact_null_draws").set_index("draw").t_max
    assert sorted(got.index) == list(range(16))
    for k in (0, 7):
        rng = np.random.default_rng([77, k])
        x, y = rng.random(400), rng.random(400)
        fx, fy = feats(x, y)
        expected = max(math.sqrt(t / 400 * (1 - t / 400)) * 400 * abs(information(fx[:t], fy[:t]) - information(fx[t:], fy[t:])) for t in sp.fraction_grid(400)[::40])
        assert got[k] >= expected - 1e-4
        left, right = sp.information_sides(fx, fy, sp.fraction_grid(400))
        share = sp.fraction_grid(400) / 400
        assert got[k] == pytest.approx(max(np.sqrt(share * (1 - share)) * 400 * np.abs(left - right)), abs=1e-4)


def test_feature_moments(run, events):
    got = run("f1_feature_moments")
    for key, (x, y) in events[2].items():
        own = got[got.series_id == key].sort_values("interval")
        assert own.cnt.sum() == len(x)
        fx, fy = feats(x, y)
        place = np.array([(t * 160) // len(x) for t in range(len(x))])
        for r in own.iloc[::17].itertuples():
            rows = np.nonzero(place == r.interval)[0]
            assert (r.cnt, r.mx, r.mj) == (len(rows), pytest.approx(state(fx[rows]).sum(), abs=TOL), pytest.approx(state(joint(fx[rows], fy[rows])).sum(), abs=TOL))


def test_combined_statistic(run, spark, events):
    """The larger of two standardised curves' maxima."""
    from tidewatch.operators import detect, scans
    from tidewatch.plans.fixtures import pairs

    curves = {"information": detect.moment_curve(detect.interval_moments(pairs(spark, events[0]))).withColumnRenamed("interval", "t").toPandas(), "spearman": scans.spearman_scan(pairs(spark, events[0])).toPandas()}
    for key in events[2]:
        tops = []
        for frame in curves.values():
            own = frame[frame.series_id == key].sort_values("t")
            z = (own.q - own.q.mean()) / (own.q.std(ddof=0) + 1e-12)
            tops.append((z.max(), int(own.t.iloc[int(np.argmax(z))])))
        row = run("i26_combined_statistic").set_index("series_id").loc[key]
        assert (row.t_max, row.tau) == (pytest.approx(max(tops)[0], abs=TOL), max(tops)[1])


def test_generated_series(run):
    got = {(r.scen, bool(r.after)): r for r in run("g_generated_series").itertuples()}
    for scen, level, idx in (("D1", 0.5, 0), ("D2", 0.7, 1), ("N2", 4.0, 0), ("G2", 0.35, 1)):
        z = generate(scen, level, 0, level_idx=idx)
        for after, part in ((False, z[:300]), (True, z[300:])):
            r = got[scen, after]
            assert (r.n, r.r, r.sd) == (300, pytest.approx(np.corrcoef(part.T)[0, 1], abs=TOL), pytest.approx(part[:, 1].std(), abs=TOL))


def test_power_study(run):
    got = run("e1_power_study").set_index("scen")
    for scen, level in (("D1", 0.7), ("D2", 0.9)):
        grid = dt.dense(600, 60)[::10]
        curve = lambda rep, null: dt.information_curve(*sp.pair_features(*generate(scen, level, rep, null=null, level_idx=2).T), grid)  # noqa: B023, E731
        threshold = np.quantile([max(curve(r, True)) for r in range(12)], 0.95)
        found = [(c.max() > threshold, grid[int(np.argmax(np.round(c, 9)))]) for c in (curve(r, False) for r in range(12))]
        row = got.loc[scen]
        assert row.detect_rate == pytest.approx(np.mean([f for f, _ in found]))
        assert row.power == pytest.approx(np.mean([f and abs(t - 300) <= 30 for f, t in found]))


def test_study_with_the_lowest_null(run):
    got = run("j14_lowest_null_study").set_index("level")
    grid = dt.dense(600, 60)[::10]
    curve = lambda level, idx, rep, null: dt.information_curve(*sp.pair_features(*generate("M2", level, rep, null=null, level_idx=idx).T), grid)
    threshold = np.quantile([max(curve(0.3, 0, r, True)) for r in range(12)], 0.95)
    for level, idx in ((0.5, 1), (0.9, 3)):
        assert got.loc[level].detect_rate == pytest.approx(np.mean([curve(level, idx, r, False).max() > threshold for r in range(12)]), abs=TOL)


def test_bandwidths_entropies_and_bias(run, events):
    for key, (x, y) in events[1].items():
        row = run("h1_bandwidths").set_index("series_id").loc[key]
        for c, name, seed in ((x, "gx", 2026), (y, "gy", 2027)):
            u = ranks(c)
            rows = np.random.default_rng(seed + 1).choice(len(u), size=min(len(u), 400), replace=False)
            assert row[name] == pytest.approx(1 / np.median([(u[a] - u[b]) ** 2 for a, b in itertools.combinations(rows, 2)]), abs=TOL)
        f = joint(*feats(x, y))
        kinds = run("h_entropies")
        own = kinds[kinds.series_id == key].set_index("kind").entropy
        assert set(own.index) == set(sp.ENTROPIES)
        assert own.tolist() == pytest.approx([entropy(state(f))] * len(own), abs=TOL)


def test_low_rank_scan_equals_whole_matrices(run, events):
    def expected(x, y, t):
        grams = []
        for u in (ranks(x), ranks(y)):
            far = np.median([(a - b) ** 2 for a, b in itertools.combinations(u, 2)])
            grams.append(np.exp(-np.subtract.outer(u, u) ** 2 / far))
        side = lambda rows: (lambda a, b: entropy(a) + entropy(b) - entropy(a * b))(*(g[rows, rows] for g in grams))
        return math.sqrt(weight(t, len(x))) * abs(side(slice(0, t)) - side(slice(t, None)))

    got = run("h7_low_rank_gram_scan")
    for key, (x, y) in events[1].items():
        t, q = curve_of(got, key)
        assert t == sp.fraction_grid(len(x)).tolist()
        assert q[::10] == pytest.approx([expected(x, y, k) for k in t[::10]], abs=1e-4)


# ---- from interval moments of single events


def edges_of(n, pieces):
    """Rows before the first, the second, ... interval edge."""
    return [0, *(sum((t * pieces) // n < k for t in range(n)) for k in range(1, pieces)), n]


def test_interval_curve(run, events):
    got = run("i3_information_scan")
    for key, (x, y) in events[2].items():
        fx, fy = feats(x, y)
        at = edges_of(len(x), 160)
        own = got[got.series_id == key].sort_values("interval")
        assert own.interval.tolist() == list(range(3, 158))
        for r in own.iloc[::6].itertuples():
            t = at[r.interval]
            sides = [entropy(state(a)) + entropy(state(b)) - entropy(state(joint(a, b))) for a, b in ((fx[:t], fy[:t]), (fx[t:], fy[t:]))]
            assert r.q == pytest.approx(math.sqrt(weight(t, len(x))) * abs(sides[0] - sides[1]), abs=1e-4)


@pytest.mark.parametrize("name", ["j2_interval_permutation_test", "j3_stratified_permutation_test"])
def test_interval_permutations(run, events, name):
    """Intervals of rows in another order, 99 times, from the features of the rows themselves."""
    x, y = events[2]["click"]
    fx, fy = feats(x, y)
    at = edges_of(len(x), 160)
    parts = [slice(a, b) for a, b in zip(at, at[1:])]
    curves, grid = [], list(range(3, 158))
    for k in range(100):
        rng, o = np.random.default_rng([7, k]), np.arange(160)
        if k and name[:2] == "j3":
            for s in range(4):
                o[s::4] = rng.permutation(o[s::4])
        elif k:
            o = rng.permutation(160)
        rows = np.concatenate([np.arange(len(x))[parts[j]] for j in o])
        cuts = np.cumsum([parts[j].stop - parts[j].start for j in o])[np.array(grid) - 1]
        left, right = sp.information_sides(fx[rows], fy[rows], cuts)
        curves.append(np.sqrt(cuts * (len(x) - cuts) / len(x)) * np.abs(left - right))
    top, tau, p = studentized(curves, grid)
    row = run(name).set_index("series_id").loc["click"]
    assert (row.observed, row.tau, row.p) == (pytest.approx(top, abs=1e-4), tau, pytest.approx(p))


def cheapest_path(cost, n, beta):
    """The cheapest partition of 0..n, first minimum on ties, by looking at all last cuts of all ends."""
    best = {0: (-beta, ())}
    for j in range(1, n + 1):
        value, k = min((best[i][0] + cost[i, j] + beta, i) for i in range(j))
        best[j] = (value, (*best[k][1], k) if k else best[k][1])
    return best[n]


def test_partitions_of_moments(run, spark, events):
    from tidewatch.operators import detect
    from tidewatch.plans.fixtures import pairs

    got = run("l1_l4_state_partition").set_index("series_id")
    candidates = {}
    for key, (x, y) in events[2].items():
        f, at = joint(*feats(x, y)), edges_of(len(x), 40)
        sums = np.concatenate([np.zeros((1, 64, 64)), np.cumsum([state(f[a:b]) for a, b in zip(at, at[1:])], axis=0)])
        cost = {(i, j): np.trace(sums[j] - sums[i]) * float(sp.ent15((sums[j] - sums[i]) / np.trace(sums[j] - sums[i]))) for i, j in itertools.combinations(range(41), 2)}
        value, cuts = cheapest_path(cost, 40, 2.0)
        assert (got.loc[key, "value"], got.loc[key, "cuts"]) == (pytest.approx(value, abs=1e-3), ",".join(map(str, cuts)))
        candidates |= {f"{key}@{c}": cost for c in cheapest_path(cost, 40, 10.0)[1]}
    found = run("p_two_stage")
    assert set(found.series_id) == set(candidates)
    assert all(r.p * 40 == pytest.approx(round(r.p * 40), abs=1e-3) and r.q >= r.p - TOL for r in found.itertuples())
    assert detect.interval_moments(pairs(spark, events[0]), pieces=40).groupBy("series_id").count().count() == len(events[2])


def test_bias_of_the_plug_in_entropy(run, events):
    """Half the variances of the moment matrix's entries in its eigenbasis, over the logarithmic means of the eigenvalues."""
    for key, (x, y) in events[1].items():
        for f, name in ((feats(x, y)[0], "bx"), (feats(x, y)[1], "by")):
            lam, v = np.linalg.eigh(f.T @ f / len(f))
            g, total = f @ v, 0.0
            for i, j in itertools.product(range(8), repeat=2):
                if min(lam[i], lam[j]) > 1e-12 * max(lam):
                    mean = lam[i] if i == j else (lam[i] - lam[j]) / math.log(lam[i] / lam[j])
                    total += np.mean((g[:, i] * g[:, j] - (lam[i] if i == j else 0)) ** 2) / mean / 2
            assert run("h9_bias_coefficients").set_index("series_id").loc[key, name] == pytest.approx(total, abs=1e-4)


# ---- experiments


def test_statistics_study(run):
    got = run("p_statistics_study").set_index(["scen", "method"])
    grid = dt.dense(600, 60)[::10]

    def spearman(x, y):
        u, v = ranks(x), ranks(y)
        return [math.sqrt(weight(t, 600)) * abs(np.corrcoef(u[:t], v[:t])[0, 1] - np.corrcoef(u[t:], v[t:])[0, 1]) for t in grid]

    def order2(x, y):
        k = [np.exp(-2 * sp.bandwidth(ranks(a)[:, None], s) * np.subtract.outer(ranks(a), ranks(a)) ** 2) for a, s in ((x, 2026), (y, 2027))]
        info = lambda rows: math.log((k[0] * k[1])[rows, rows].sum() * len(k[0][rows]) ** 2 / (k[0][rows, rows].sum() * k[1][rows, rows].sum()))
        return [math.sqrt(weight(t, 600)) * abs(info(slice(0, t)) - info(slice(t, 600))) for t in grid]

    for scen, level in (("D1", 0.8), ("D2", 0.9)):
        for name, curve in (("spearman", spearman), ("order2", order2)):
            tops = [max(curve(*generate(scen, level, r, null=True, level_idx=2).T)) for r in range(10)]
            found = [max(curve(*generate(scen, level, r, level_idx=2).T)) > np.quantile(tops, 0.95) for r in range(10)]
            assert got.loc[(scen, name), "detect_rate"] == pytest.approx(np.mean(found))
    assert got.loc[("D1", "spearman"), "detect_rate"] > got.loc[("D2", "spearman"), "detect_rate"]


def test_segmentation_study(run):
    got = run("p_segmentation_study").set_index(["level", "method"])
    assert set(got.index) == {(v, m) for v in (0.8, 0.9) for m in ("products", "scales", "states")}
    for level, idx in ((0.8, 0), (0.9, 1)):
        found = [dt.bg_segments(z[:, 0] * z[:, 1], 3.0) for z in (generate("P1", level, r, level_idx=idx) for r in range(4))]
        true, row = [450, 900, 1350], got.loc[(level, "products")]
        far = lambda a, b: max(min(abs(u - v) for v in b) for u in a)
        apart = [max(far(true, c), far(c, true)) if c else 1800 for c in found]
        label = lambda cuts: np.searchsorted(sorted(cuts), np.arange(1, 1801), "left")

        def rand(a, b):
            pairs_ = lambda v: sum(n * (n - 1) / 2 for n in np.unique(v, return_counts=True)[1])
            both, i, j, m = pairs_(a * 1000 + b), pairs_(a), pairs_(b), 1800 * 1799 / 2
            return (both - i * j / m) / ((i + j) / 2 - i * j / m) if (i + j) / 2 != i * j / m else 1.0

        assert row.reps == 4 and row.mean_k == pytest.approx(np.mean([len(c) for c in found])) and row.k_correct == pytest.approx(np.mean([len(c) == 3 for c in found]))
        assert row.hausdorff_median == pytest.approx(np.median(apart))
        agree = [[rand(label(true), label(c)) for c in found], [rand(np.searchsorted(true, np.arange(1, 1801), "right"), np.searchsorted(sorted(c), np.arange(1, 1801), "right")) for c in found]]
        assert any(row.ari_mean == pytest.approx(np.mean(a), abs=TOL) for a in agree)


def test_split_halves(run, spark, events):
    """Candidates of a half are those of its own rows; each is tested on the other half's."""
    from tidewatch.operators.series import alternating_split
    from tidewatch.plans.fixtures import pairs

    found = run("p_split_halves")
    for key, (x, y) in events[2].items():
        n = len(x) // 20 * 20
        for half, odd in (("A", 0), ("B", 1)):
            rows = [t for t in range(n) if t // 20 % 2 == odd and 1 <= t % 20 < 19]
            fx, fy = feats(x[rows], y[rows])
            f, at = joint(fx, fy), edges_of(len(rows), 24)
            cost = {(i, j): (at[j] - at[i]) * entropy(state(f[at[i] : at[j]])) for i, j in itertools.combinations(range(25), 2)}
            own = found[(found.chosen == half) & found.series_id.str.startswith(f"{key}@")]
            assert sorted(int(s.split("@")[1]) for s in own.series_id) == list(cheapest_path(cost, 24, 1.0)[1])
    dealt = alternating_split(pairs(spark, events[0]).withColumn("at", F.col("t") - 1), "at", 20, 1, ["series_id"]).groupBy("series_id", "half").count().collect()
    assert {(r.series_id, r.half): r["count"] for r in dealt} == {(k, h): 18 * len([b for b in range(len(x) // 20) if b % 2 == (h == "B")]) for k, (x, _) in events[2].items() for h in "AB"}
