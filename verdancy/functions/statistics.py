"""Aggregate expressions: least squares with intervals, box-plot summaries, t quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def moments(y: str, x: str) -> list[Column]:
    """n, means, sums of squares and the fit of y on x; rows where either is null take no part."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return [
        F.count(F.when(both, 1)).alias("n"),
        F.regr_avgx(y, x).alias("mx"),
        F.regr_avgy(y, x).alias("my"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
    ]


def fitted(df: DataFrame, z: float | Column = Z95) -> DataFrame:
    """Slope, intercept, r2, standard error and slope interval from moments(); null below two points or without spread."""
    ok = (F.col("n") >= 2) & (F.col("sxx") > 0)
    slope = F.when(ok, F.col("sxy") / F.col("sxx"))
    residual = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    se = F.when(F.col("n") == 2, 0.0).when(F.col("n") > 2, F.sqrt(residual / (F.col("n") - 2) / F.col("sxx")))
    df = df.withColumn("slope", slope).withColumn("intercept", F.when(ok, F.col("my") - slope * F.col("mx")))
    df = df.withColumn("r2", F.when(ok & (F.col("syy") > 0), F.col("sxy") * F.col("sxy") / F.col("sxx") / F.col("syy")))
    df = df.withColumn("stderr", F.when(ok, se))
    return df.withColumn("ci_low", F.col("slope") - z * F.col("stderr")).withColumn("ci_high", F.col("slope") + z * F.col("stderr"))


def band(df: DataFrame, low: str, high: str, points: int) -> DataFrame:
    """The fit of moments() and its 95 % mean band on a grid of points between two columns; groups with n < 3 have no rows."""
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    grid = fitted(df).where("n >= 3 and slope is not null").select("*", step)
    x = F.col(low) + (F.col(high) - F.col(low)) * F.col("k") / (points - 1)
    s = F.sqrt(F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / (F.col("n") - 2))
    half = Z95 * s * F.sqrt(1 / F.col("n") + F.pow(F.col("x") - F.col("mx"), 2) / F.col("sxx"))
    grid = grid.withColumn("x", x).withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x")).withColumn("_half", half)
    return grid.withColumn("lower", F.col("fit") - F.col("_half")).withColumn("upper", F.col("fit") + F.col("_half"))


def standard_error(x: str) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def t_quantile(df: int, p: float = 0.975) -> float:
    """Student's t quantile by bisection on the distribution function (integrated in the angle, where it is smooth)."""
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def below(t: float) -> float:
        end, n = math.atan(t / math.sqrt(df)), 400
        h = end / n
        f = [math.cos(i * h) ** (df - 1) for i in range(n + 1)]
        area = h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
        return 0.5 + norm * math.sqrt(df) * area

    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2
