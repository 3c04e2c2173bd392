"""Natural breaks, smoothed densities, spatial medians and t intervals against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdancy.functions.statistics import t_quantile
from verdancy.operators.aggregates import natural_breaks, smoothed_density
from verdancy.operators.trends import geometric_median, theil_sen_spatial, trend_with_t


def exact_breaks(values, k):
    """Programme over all distinct values; the best last break moves on with the value, so each is searched between its neighbours'."""
    v, n = np.unique(values, return_counts=True)
    c, s, s2 = (np.r_[0, np.cumsum(x)] for x in (n, n * (v - values.mean()), n * (v - values.mean()) ** 2))
    m = len(v)
    cost, cuts = np.r_[0, s2[1:] - s[1:] ** 2 / c[1:]], []
    cost[0] = np.inf
    for _ in range(k - 1):
        after, cut = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        stack = [(1, m, 0, m)]
        while stack:
            a, b, lo, hi = stack.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(lo, min(hi, j - 1) + 1)
            total = cost[i] + (s2[j] - s2[i]) - (s[j] - s[i]) ** 2 / (c[j] - c[i]) if len(i) else np.array([np.inf])
            at = int(total.argmin())
            after[j], cut[j] = total[at], (i[at] if len(i) else lo)
            stack += [(a, j - 1, lo, cut[j]), (j + 1, b, cut[j], hi)]
        cost, cuts = after, [*cuts, cut]
    out, j = [v[-1]], m
    for cut in reversed(cuts):
        j = cut[j]
        out.append(v[j - 1])
    return out[::-1]


@pytest.mark.parametrize(("kind", "n"), [("normal", 100_000), ("skewed", 20_000), ("few", 3000)])
def test_natural_breaks_equal_the_exact_programme(spark, kind, n):
    r = np.random.default_rng(n)
    values = {"normal": lambda: r.normal(0, 1, n), "skewed": lambda: np.exp(r.normal(0, 1.5, n)), "few": lambda: r.integers(0, 40, n) ** 2 / 7.0}[kind]()
    df = spark.createDataFrame([(float(x),) for x in values], "v double")
    assert natural_breaks(df, "v", 5, bins=200) == exact_breaks(values, 5)


def test_few_values_give_even_steps(spark):
    assert natural_breaks(spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "v double"), "v", 4) == pytest.approx([0.25, 0.5, 0.75, 1.0])
    assert natural_breaks(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 2) == [3.0, 3.0]


def test_density_equals_a_sum_of_kernels(spark):
    r = np.random.default_rng(3)
    rows = [(g, float(a), float(b)) for g, n in ((0, 400), (1, 60)) for a, b in np.c_[r.normal(g, 1 + g, n), r.exponential(2, n)]]
    df = spark.createDataFrame([*rows, (2, 1.0, 1.0), (2, 1.0, 2.0), (0, None, 3.0)], "g int, x double, y double")
    got = smoothed_density(df, ["g"], "x", "y", 80, 1.1).collect()
    assert 2 * 80 * 78 < len(got) <= 2 * 80 * 80
    for g in (0, 1):
        p = np.array([(a, b) for k, a, b in rows if k == g])
        hx, hy = p.std(0, ddof=1) * len(p) ** (-1 / 6) * 1.1
        own = [q for q in got if q.g == g]
        x, y, f = (np.array([q[c] for q in own]) for c in ("x", "y", "density"))
        expected = sum(np.exp(-((x - a) ** 2) / 2 / hx**2 - (y - b) ** 2 / 2 / hy**2) for a, b in p) / (2 * math.pi * hx * hy * len(p))
        assert np.abs(f - expected).max() < 0.01 * expected.max()
        assert math.isclose(f.sum() * (np.unique(x)[1] - np.unique(x)[0]) * (np.unique(y)[1] - np.unique(y)[0]), 1, rel_tol=0.01)


def solved(points):
    """A plain search: the best of a lattice, which shrinks round its best node; the points themselves compete too."""
    cost = lambda q: np.sqrt(((points - q) ** 2).sum(1)).sum()
    at, size = np.median(points, 0), np.ptp(points, 0) + 1e-12
    for _ in range(400):
        nodes = at + size * np.array([(i, j) for i in np.linspace(-1, 1, 9) for j in np.linspace(-1, 1, 9)])
        at, size = nodes[np.argmin([cost(q) for q in nodes])], size * 0.85
    return min([at, *points], key=cost)


def test_geometric_median_equals_a_plain_search():
    r = np.random.default_rng(5)
    for n in (3, 4, 10, 60):
        p = r.normal(0, 1, (n, 2)) * (1, 20)
        assert np.allclose(geometric_median(p), solved(p), atol=1e-6 * 20)
    many = np.array([(1.0, 2.0)] * 5 + [(3.0, 4.0), (9.0, 1.0)])
    assert np.allclose(geometric_median(many), (1, 2)) and np.allclose(geometric_median(many[:1]), (1, 2))


def test_spatial_theil_sen(spark):
    r = np.random.default_rng(6)
    rows = [(g, float(x), float(2 * x + r.normal(0, 1) + (30 if x == 4 else 0))) for g in range(3) for x in range(12)] + [(7, 1.0, 1.0), (7, 1.0, 2.0), (8, 1.0, None)]
    got = {q.g: (q.slope, q.intercept) for q in theil_sen_spatial(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()}
    assert got.keys() == {0, 1, 2, 7} and got[7] == (None, None)
    for g in range(3):
        p = [(x, y) for k, x, y in rows if k == g]
        lines = np.array([((d - b) / (c - a), b - (d - b) / (c - a) * a) for k, (a, b) in enumerate(p) for c, d in p[k + 1 :]])
        assert np.allclose(got[g], solved(lines), atol=1e-5)


def test_t_beyond_the_table(spark):
    for n in (50, 63, 1002):
        df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("x"), (F.col("id") * 2 + F.pmod(F.xxhash64("id"), F.lit(7))).alias("y"))
        r = trend_with_t(df, ["g"], "x", "y").first()
        x = np.arange(n)
        y = np.array([q.y for q in df.orderBy("x").collect()], float)
        slope, inner = np.polyfit(x, y, 1)
        e = y - slope * x - inner
        s = math.sqrt(e @ e / (n - 2) / ((x - x.mean()) ** 2).sum())
        assert (r.ci_high - r.slope) / s == pytest.approx(t_quantile(n - 2), rel=1e-6)
