"""Trends, dependence fits, anomalies and drought indices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdancy.functions.statistics import band, fitted, moments, t_quantile
from verdancy.operators.aggregates import baseline
from verdancy.operators.cleaning import outer_halves


def trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope of y on x with its 95 % interval, per group."""
    return fitted(df.groupBy(*by).agg(*moments(y, x)))


def trend_with_t(df: DataFrame, by: list[str], x: str, y: str, most: int = 60) -> DataFrame:
    """As trend(), the interval by Student's t: tabulated up to `most` degrees of freedom, by its series in 1 / df beyond."""
    spark = df.sparkSession
    table = spark.createDataFrame([(k, t_quantile(k)) for k in range(1, most + 1)], "_k int, _t double")
    z = float(_normal_quantile(np.array([0.975]))[0])
    series = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    m = df.groupBy(*by).agg(*moments(y, x)).withColumn("df", F.greatest(F.col("n") - 2, F.lit(1))).withColumn("_k", F.least("df", F.lit(most)).cast("int"))
    beyond = sum((F.lit(c) / F.pow("df", F.lit(float(k))) for k, c in enumerate(series[1:], 1)), F.lit(series[0]))
    wide = m.join(F.broadcast(table), "_k").withColumn("t", F.when(F.col("df") <= most, F.col("_t")).otherwise(beyond)).drop("_k", "_t")
    return fitted(wide, F.col("t"))


def trend_table(df: DataFrame, scenario: str, region: str, season: str, x: str, y: str) -> DataFrame:
    """Slope per scenario, region and season beside the slope over all regions and their difference."""
    own = trend(df, [scenario, region, season], x, y).select(scenario, region, season, "slope", "ci_low", "ci_high")
    whole = trend(df, [scenario, season], x, y).select(scenario, season, F.col("slope").alias("global_slope"))
    return own.join(whole, [scenario, season]).withColumn("delta_abs", F.col("slope") - F.col("global_slope"))


def effect_fit(df: DataFrame, by: list[str], x: str, y: str, points: int = 80) -> DataFrame:
    """Fit of y on x with its mean band on an even grid over the group's range; groups below three points have none."""
    m = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(*moments(y, x), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return band(m, "lo", "hi", points).select(*by, "k", "x", "fit", "lower", "upper", "slope", "r2")


def dependence_fit(df: DataFrame, by: list[str], feature: str, contribution: str, points: int = 100, counts: DataFrame | None = None) -> DataFrame:
    """Outer quarters of the feature, split at their median into low and high, each fitted with its band; counts as for outer_halves()."""
    rows = df.select(*by, feature, contribution).na.drop()
    return effect_fit(outer_halves(rows, feature, by, counts), [*by, "half"], feature, contribution, points)


def theil_sen(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Median of the slopes between all pairs of points of a series, and the median intercept.

    Series are short (years); a group's points travel as one array and its pairs are made inside the row.
    """
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b["x"] > a["x"]), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))))
    slopes = p.select(*by, "p", F.explode(pairs).alias("s")).groupBy(*by).agg(F.percentile("s", 0.5).alias("slope"), F.first("p").alias("p"))
    rest = slopes.select(*by, "slope", F.explode("p").alias("q")).select(*by, "slope", (F.col("q.y") - F.col("slope") * F.col("q.x")).alias("r"))
    return rest.groupBy(*by, "slope").agg(F.percentile("r", 0.5).alias("intercept"))


def geometric_median(points: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The point of least summed distance to the rows of `points`: reweighted means, then Newton steps where the median isn't one of the points."""
    scale = np.abs(points - points.mean(0)).max() or 1.0
    p, at = points / scale, np.median(points, 0) / scale

    def cost(q: np.ndarray) -> float:
        return float(np.sqrt(((p - q) ** 2).sum(1)).sum())

    for _ in range(rounds):
        d = np.sqrt(((p - at) ** 2).sum(1))
        far = d > 1e-14
        w = 1 / d[far]
        pull = ((p[far] - at) * w[:, None]).sum(0)
        here, size = float((~far).sum()), float(np.sqrt(pull @ pull))
        if size <= here:  # the pull of the other points doesn't move it off its own
            break
        step = pull / w.sum() * (1 - here / size)
        if not here:
            u = (p - at) * w[:, None]
            hessian = np.eye(p.shape[1]) * w.sum() - (u * w[:, None]).T @ u
            if np.linalg.cond(hessian) < 1e12:
                newton = np.linalg.solve(hessian, pull)
                step = newton if cost(at + newton) <= cost(at + step) else step
        at = at + step
        if np.abs(step).max() < 1e-15:
            break
    nearest = p[((p - at) ** 2).sum(1).argmin()]
    return (nearest if cost(nearest) <= cost(at) else at) * scale


def theil_sen_spatial(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spatial median of (slope, intercept) of the lines through all pairs of points of a series: slope and intercept, null below two different x.

    Series are short (years); a group's points travel as one array and its lines are made inside the row.
    """
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    slopes = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b["x"] > a["x"]), lambda b: F.struct(((b["y"] - a["y"]) / (b["x"] - a["x"])).alias("s"), (a["y"] - (b["y"] - a["y"]) / (b["x"] - a["x"]) * a["x"]).alias("i")))))
    lines = p.select(*by, slopes.alias("l")).select(*by, F.col("l.s").alias("_s"), F.col("l.i").alias("_i"))

    @F.pandas_udf("slope double, intercept double")
    def median(s: pd.Series, i: pd.Series) -> pd.DataFrame:
        out = [geometric_median(np.column_stack([a, b])) if len(a) else (None, None) for a, b in zip(s, i, strict=True)]
        return pd.DataFrame(out, columns=["slope", "intercept"], dtype=float)

    done = lines.select(*by, median("_s", "_i").alias("m"))
    return done.select(*by, *(F.when(~F.isnan(f"m.{c}"), F.col(f"m.{c}")).alias(c) for c in ("slope", "intercept")))


def theil_sen_draws(df: DataFrame, by: list[str], x: str, y: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Slope and intercept of each bootstrap draw (`rep`): a draw takes as many points of a series, by hash, with replacement. A draw of a single x has none."""
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    drawn = p.select(*by, "p", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("rep"))
    lot = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
    picked = drawn.select(*by, "rep", F.explode(F.transform("p", lambda _, i: F.element_at("p", (F.pmod(lot(i), F.size("p")) + 1).cast("int")))).alias("q"))
    return theil_sen(picked.select(*by, "rep", F.col("q.x").alias(x), F.col("q.y").alias(y)), [*by, "rep"], x, y)


def theil_sen_band(df: DataFrame, by: list[str], x: str, y: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """2.5 and 97.5 percentiles of the slope over bootstrap draws."""
    slopes = theil_sen_draws(df, by, x, y, draws, seed)
    return slopes.groupBy(*by).agg(F.percentile("slope", 0.025).alias("low"), F.percentile("slope", 0.975).alias("high"))


def theil_sen_prediction_band(df: DataFrame, by: list[str], x: str, y: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Fit and 2.5 and 97.5 percentiles of the predictions of bootstrap draws at each x of a series."""
    at = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x")).distinct()
    line = F.col("intercept") + F.col("slope") * F.col("x")
    drawn = at.join(theil_sen_draws(df, by, x, y, draws, seed), by).groupBy(*by, "x").agg(F.percentile(line, 0.025).alias("low"), F.percentile(line, 0.975).alias("high"))
    return drawn.join(theil_sen(df, by, x, y), by).select(*by, "x", line.alias("fit"), "low", "high")


def window_anomaly(windows: DataFrame, yearly: DataFrame, keys: list[str], value: str, by: list[str]) -> DataFrame:
    """Climate anomaly of each window: mean over cells of (window mean - baseline), in units of the baselines' spread."""
    base = baseline(yearly, keys, value)
    joined = windows.join(base, keys)
    both = joined.groupBy(*by).agg(F.avg(F.col(value) - F.col("baseline")).alias("d"), F.stddev_samp("baseline").alias("s"))
    return both.select(*by, F.try_divide("d", "s").alias("z"))


# Rational approximation of the inverse normal distribution (relative error 1.2e-9).
_CENTRE = ((-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239), (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0))
_TAIL = ((-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0))
_TAIL_BELOW = 0.02425


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution for 0 < p < 1."""
    q = p - 0.5
    r = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    centre = np.polyval(_CENTRE[0], q * q) * q / np.polyval(_CENTRE[1], q * q)
    tail = np.polyval(_TAIL[0], r) / np.polyval(_TAIL[1], r)
    return np.where(np.minimum(p, 1 - p) < _TAIL_BELOW, np.where(q < 0, tail, -tail), centre)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 8, brought down by recurrence."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - sum(np.log(x + k) for k in range(8))


def _gamma_cdf(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function by its power series; far in the tail it is 1."""
    x, term = np.maximum(x, 0), 1 / shape
    total = term.copy()
    for k in range(1, 2000):
        term = term * x / (shape + k)
        total += term
        if (term < 1e-14 * total).all():
            break
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = np.where(x > 0, total * np.exp(-x + shape * np.log(np.where(x > 0, x, 1)) - _log_gamma(shape)), 0)
    return np.clip(np.nan_to_num(out, nan=1.0), 0, 1)


def spei(monthly: DataFrame, keys: list[str], year: str, month: str, water: str, scale: int = 3, calibration: tuple[int, int] = (1951, 2021)) -> DataFrame:
    """Standardised index of the rolling `scale`-month sum of a water balance.

    Sums are shifted to be positive and fitted, per key and calendar month over the calibration years, by a gamma
    distribution (Thom's estimator); the distribution's value becomes a normal quantile. Months without a full window
    have no index, nor have months whose sums don't vary.
    """
    w = Window.partitionBy(*keys).orderBy(year, month).rowsBetween(-(scale - 1), 0)
    rolled = monthly.withColumn("_s", F.when(F.count(water).over(w) == scale, F.sum(water).over(w)))
    own = Window.partitionBy(*keys, month)
    calib = F.when(F.col(year).between(*calibration), F.col("_s"))
    shifted = rolled.withColumn("_p", F.col("_s") - F.min(calib).over(own) + 0.01 * (F.max(calib).over(own) - F.min(calib).over(own)) + 1e-6)
    pc = F.when(F.col(year).between(*calibration) & (F.col("_p") > 0), F.col("_p"))
    fit = shifted.withColumn("_m", F.avg(pc).over(own)).withColumn("_a", F.log("_m") - F.avg(F.log(pc)).over(own))
    shape = F.when(F.col("_a") > 1e-9, (1 + F.sqrt(1 + 4 * F.col("_a") / 3)) / (4 * F.col("_a")))

    @F.pandas_udf("double")
    def index(p: pd.Series, k: pd.Series, m: pd.Series) -> pd.Series:
        ok = (p.notna() & k.notna() & m.notna()).to_numpy()
        out = np.full(len(p), np.nan)
        if ok.any():
            kk = k.to_numpy(float)[ok]
            cdf = _gamma_cdf(p.to_numpy(float)[ok] / (m.to_numpy(float)[ok] / kk), kk)
            out[ok] = _normal_quantile(np.clip(cdf, 1e-6, 1 - 1e-6))
        return pd.Series(out)

    done = fit.withColumn("spei", index("_p", shape, "_m"))
    return done.withColumn("spei", F.when(~F.isnan("spei"), F.col("spei"))).drop("_s", "_p", "_m", "_a")


def spei_rank(monthly: DataFrame, keys: list[str], year: str, month: str, water: str, scale: int = 3) -> DataFrame:
    """The index in its rank form: plotting position (rank - 0.44) / (n + 0.12) of the rolling sum within its calendar month."""
    w = Window.partitionBy(*keys).orderBy(year, month).rowsBetween(-(scale - 1), 0)
    rolled = monthly.withColumn("rolled", F.round(F.when(F.count(water).over(w) == scale, F.sum(water).over(w)), 6)).where("rolled is not null")
    own = Window.partitionBy(*keys, month)
    return rolled.withColumn("position", (F.rank().over(own.orderBy("rolled")) - 0.44) / (F.count("*").over(own) + 0.12))
