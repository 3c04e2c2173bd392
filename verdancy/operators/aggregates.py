"""Grouped summaries of observations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdancy.operators.cleaning import beside_groups, quantiles
from verdancy.session import written


def annual_means(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(F.avg(value).alias(value))


def slice_means(df: DataFrame, keys: list[str], year: str, slice_id: str, value: str) -> DataFrame:
    """Annual mean over slices, those left out that hold a single value all over; a missing value makes the mean missing."""
    flat = df.groupBy(year, slice_id).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo = hi or lo is null").select(year, slice_id)
    mean = F.when(F.count(value) == F.count("*"), F.sum(value) / F.count("*"))
    return df.join(flat, [year, slice_id], "left_anti").groupBy(*keys, year).agg(mean.alias(value))


def degree_days(df: DataFrame, keys: list[str], ts: str, t: str, base: float = 5.0) -> DataFrame:
    """Daily growing-degree value: mean of highest and lowest less the base, 0 at least and where all is missing."""
    day = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.max(t).alias("hi"), F.min(t).alias("lo"))
    return day.select(*keys, "day", F.greatest(F.coalesce((F.col("hi") + F.col("lo")) / 2 - base, F.lit(0.0)), F.lit(0.0)).alias("gdd"))


def chilling_days(df: DataFrame, keys: list[str], ts: str, t: str, base: float = 5.0) -> DataFrame:
    """Daily flag: 1 where the day's mean is below the base, 0 where it isn't, null where it is missing."""
    day = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.avg(t).alias("mean"))
    return day.select(*keys, "day", F.when(F.col("mean") < base, 1).when(F.col("mean") >= base, 0).alias("chilling"))


def baseline(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Long-term mean per key."""
    return df.groupBy(*keys).agg(F.avg(value).alias("baseline"))


def box_summary(value: str) -> list[Column]:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")]


def _beside(summary: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """Quantiles beside other aggregates; groups without a value have none."""
    return summary.join(q, by, "left") if by else summary.crossJoin(q)


def box_whiskers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles and whiskers: the outermost values within 1.5 interquartile ranges."""
    box = quantiles(df, value, by, {"q1": 0.25, "median": 0.5, "q3": 0.75}, ranked=True)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = beside_groups(df, box, by).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*by).agg(*(F.first(c).alias(c) for c in ("q1", "median", "q3")), F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))


def whisker_summary(df: DataFrame, by: list[str], value: str, axis_range: float = 1.0) -> DataFrame:
    """5 %, 50 % and 95 % points and mean; below three values, or without spread, the mean and 1 % of the axis to both sides."""
    q = quantiles(df, value, by, {"q0": 0.05, "q1": 0.5, "q2": 0.95}, ranked=True).select(*by, F.array("q0", "q1", "q2").alias("q"))
    s = _beside(df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n")), q, by)
    thin = (F.col("n") < 3) | (F.col("q")[0] == F.col("q")[2])
    pick = lambda k, d: F.when(thin, F.col("mean") + d * 0.01 * axis_range).otherwise(F.col("q")[k])
    return s.select(*by, "n", "mean", pick(0, -1).alias("q05"), pick(1, 0).alias("q50"), pick(2, 1).alias("q95"))


def robust_range(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """2nd and 98th percentile, or the extremes where these fall together."""
    q = quantiles(df, value, by, {"q0": 0.02, "q1": 0.98}, ranked=True).select(*by, F.array("q0", "q1").alias("q"))
    s = _beside(df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi")), q, by)
    flat = F.col("q")[0] >= F.col("q")[1]
    return s.select(*by, F.when(flat, F.col("lo")).otherwise(F.col("q")[0]).alias("low"), F.when(flat, F.col("hi")).otherwise(F.col("q")[1]).alias("high"))


def zonal_profile(df: DataFrame, axis: str, value: str) -> DataFrame:
    return df.groupBy(axis).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin number 0.. of a value in low..high; the upper end is in the last bin, what lies outside is in none."""
    at = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return F.when(value.between(low, high), at)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 40) -> DataFrame:
    """Density per bin: counts over total and bin width."""
    counts = df.select(bin_of(F.col(value), low, high, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select("bin", "n", (F.col("n") / F.col("whole") / ((high - low) / bins)).alias("density"))


def density_2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 50) -> DataFrame:
    cells = df.select(bin_of(F.col(x), *x_range, bins).alias("bx"), bin_of(F.col(y), *y_range, bins).alias("by"))
    return cells.where("bx is not null and by is not null").groupBy("bx", "by").agg(F.count("*").alias("n"))


def smoothed_density(df: DataFrame, by: list[str], x: str, y: str, grid: int = 100, adjust: float = 1.0, cut: float = 3.0) -> DataFrame:
    """Gaussian density of the points of each group on a grid x grid lattice that reaches `cut` bandwidths beyond them: by, i, j, x, y, density.

    Bandwidths are n^(-1/6) standard deviations of each axis, times `adjust`. A point is dealt to the four nodes around
    it by its distances and nodes are added up, so what follows has the size of the lattice; the kernel is a product,
    so rows are smoothed, then columns. Nodes farther than six bandwidths from all points, and groups without spread on both
    axes, have no row.
    """
    points = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    m = points.groupBy(*by).agg(F.count("*").alias("_n"), *(a for c in ("_x", "_y") for a in (F.min(c).alias(f"{c}lo"), F.max(c).alias(f"{c}hi"), (F.stddev_samp(c)).alias(f"{c}s"))))
    m = m.where("_xs > 0 and _ys > 0")
    for c in ("_x", "_y"):
        m = m.withColumn(f"{c}h", F.col(f"{c}s") * F.pow("_n", F.lit(-1 / 6)) * adjust)
        m = m.withColumn(f"{c}0", F.col(f"{c}lo") - cut * F.col(f"{c}h")).withColumn(f"{c}d", (F.col(f"{c}hi") - F.col(f"{c}lo") + 2 * cut * F.col(f"{c}h")) / (grid - 1))
    m = written(m.select(*by, "_n", *(f"{c}{p}" for c in ("_x", "_y") for p in ("h", "0", "d"))))
    both = points.join(m, by) if by else points.crossJoin(F.broadcast(m))

    def nodes(c: str) -> Column:
        at = (F.col(c) - F.col(f"{c}0")) / F.col(f"{c}d")
        low = F.floor(at).cast("int")
        return F.array(F.struct(low.alias("k"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("k"), (at - low).alias("w")))

    dealt = both.select(*by, F.explode(nodes("_x")).alias("a"), nodes("_y").alias("b")).select(*by, "a", F.explode("b").alias("b"))
    cells = dealt.groupBy(*by, F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("w"))
    for c, axis in (("_x", "i"), ("_y", "j")):
        wide = cells.join(m, by) if by else cells.crossJoin(F.broadcast(m))
        reach = F.ceil(6 * F.col(f"{c}h") / F.col(f"{c}d")).cast("int")
        to = F.explode(F.sequence(F.greatest(F.col(axis) - reach, F.lit(0)), F.least(F.col(axis) + reach, F.lit(grid - 1)))).alias("to")
        u = (F.col("to") - F.col(axis)) * F.col(f"{c}d") / F.col(f"{c}h")
        kernel = F.exp(-u * u / 2) / (F.sqrt(F.lit(2 * math.pi)) * F.col(f"{c}h"))
        cells = wide.select("*", to).groupBy(*by, F.col("to").alias(axis), "j" if axis == "i" else "i").agg(F.sum(F.col("w") * kernel).alias("w"))
    out = cells.join(m, by) if by else cells.crossJoin(F.broadcast(m))
    return out.select(*by, "i", "j", (F.col("_x0") + F.col("i") * F.col("_xd")).alias("x"), (F.col("_y0") + F.col("j") * F.col("_yd")).alias("y"), (F.col("w") / F.col("_n")).alias("density"))


def regression_metrics(df: DataFrame, by: list[str], true: str, predicted: str) -> DataFrame:
    """R2, mean squared and mean absolute error per group."""
    e = F.col(true) - F.col(predicted)
    m = df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(true).alias("v"))
    return m.select(*by, F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"), "mse", "mae")


def _best_cuts(n: np.ndarray, s: np.ndarray, s2: np.ndarray, k: int) -> list[int]:
    """Number of the last of each class's bins: k classes of least squared deviation, by a dynamic programme over the bins' counts and sums."""
    n, s, s2 = (np.r_[0, np.cumsum(x)] for x in (n, s, s2))
    m = len(n) - 1
    cost = np.full((k + 1, m + 1), np.inf)
    cost[0, 0] = 0
    cut = np.zeros((k + 1, m + 1), int)
    for c in range(1, k + 1):
        for j in range(c, m + 1):
            i = np.arange(c - 1, j)
            within = (s2[j] - s2[i]) - (s[j] - s[i]) ** 2 / (n[j] - n[i])
            total = cost[c - 1, i] + within
            at = int(total.argmin())
            cost[c, j], cut[c, j] = total[at], i[at]
    out, j = [], m
    for c in range(k, 0, -1):
        out.append(j - 1)
        j = cut[c, j]
    return out[::-1]


def natural_breaks(df: DataFrame, value: str, k: int = 5, bins: int = 1000, around: int = 3, parts: int = 32) -> list[float]:
    """Upper bounds of k classes of least squared deviation, exact to the value.

    Spark counts a histogram; a dynamic programme over its bins finds the breaks. Then the bins within `around` of each
    break are cut into `parts` and counted again, until the bins at the breaks hold a single value each and the breaks
    stay. The driver sees bins only, some hundreds beyond `bins` each round. Fewer distinct values than classes give
    even steps.
    """
    known = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean")).first()
    if ends["lo"] is None:
        return []
    lo, hi, mean = float(ends["lo"]), float(ends["hi"]), float(ends["mean"])
    if lo == hi:
        return [hi] * k
    edges = np.linspace(lo, hi, bins + 1)[1:-1]
    known, last = written(known), None
    while True:
        edges = np.unique(edges[(edges > lo) & (edges <= hi)])
        binned = Bucketizer(splits=[-math.inf, *edges.tolist(), math.inf], inputCol="v", outputCol="bin").transform(known)
        d = F.col("v") - mean
        rows = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("s2"), F.min("v").alias("low"), F.max("v").alias("top")).orderBy("bin").collect()
        n, s, s2, low, top = (np.array([float(r[c]) for r in rows]) for c in ("n", "s", "s2", "low", "top"))
        near = {i for c in (_best_cuts(n, s, s2, k) if len(rows) >= k else range(len(rows))) for i in range(max(0, c - around + 1), min(len(rows), c + around + 1))}
        open_bins = [i for i in sorted(near) if low[i] < top[i]]
        if not open_bins:
            if len(rows) < k:
                return np.linspace(lo, hi, k + 1)[1:].tolist()
            found = [float(top[c]) for c in _best_cuts(n, s, s2, k)]
            if found == last:
                return found
            last = found
            continue
        # between the bin's own least and largest value, both ends apart, so that every round tells at least two values
        edges = np.concatenate([edges, *(np.r_[np.linspace(low[i], top[i], parts + 1)[1:], np.nextafter(low[i], np.inf)] for i in open_bins)])


def classed(value: Column, breaks: list[float]) -> Column:
    """Class number 0.. by upper bounds."""
    out = F.lit(len(breaks) - 1)
    for i in range(len(breaks) - 2, -1, -1):
        out = F.when(value <= breaks[i], i).otherwise(out)
    return F.when(value.isNotNull(), out)


def symmetric_limit(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Colour limit: the median over groups of the 95th percentile of absolute values, between 0.25 and 0.5."""
    p = quantiles(df.select(*by, F.abs(F.col(value)).alias("_abs")), "_abs", by, {"p": 0.95}, ranked=True)
    return p.agg(F.least(F.lit(0.5), F.greatest(F.lit(0.25), F.percentile("p", 0.5))).alias("limit"))


def station_extent(periods: DataFrame, station: str, start: str, end: str, first: list[str], order: str) -> DataFrame:
    """First start and last end of each station over its files, and other columns as they come first."""
    return periods.groupBy(station).agg(F.min(start).alias("start"), F.max(end).alias("end"), *(F.min_by(c, order).alias(c) for c in first))


def thornthwaite_pet(monthly: DataFrame, keys: list[str], year: str, t: str) -> DataFrame:
    """Potential evapotranspiration from monthly means: heat index of the year over months above zero, 0 below zero."""
    w = Window.partitionBy(*keys, year)
    warm = F.when(F.col(t) > 0, F.col(t))
    heat = F.sum(F.pow(warm / 5, F.lit(1.514))).over(w)
    a = 6.75e-7 * F.pow("heat", F.lit(3.0)) - 7.71e-5 * F.pow("heat", F.lit(2.0)) + 1.792e-2 * F.col("heat") + 0.49239
    df = monthly.withColumn("heat", F.coalesce(heat, F.lit(0.0)))
    return df.withColumn("pet", F.when(F.col(t) > 0, 16 * F.pow(10 * F.col(t) / F.col("heat"), a)).otherwise(0.0)).drop("heat")
