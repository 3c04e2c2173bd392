"""Analyses over several seasons, drivers and datasets at once: one job for all panels of a figure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdancy.functions.scalars import absolute_share
from verdancy.operators.aggregates import bin_of, classed, natural_breaks
from verdancy.operators.calendar import sliding_windows
from verdancy.operators.trends import dependence_fit, trend


def season_shares(contrib: DataFrame, window: str, seasons: list[str]) -> DataFrame:
    """Mean absolute share of each season per window, in long form."""
    shares = contrib.select(window, *(absolute_share(s, *seasons).alias(s) for s in seasons))
    return shares.unpivot([window], seasons, "season", "share").groupBy("season", window).agg(F.avg("share").alias("share"))


def trend_anomaly_panels(contrib: DataFrame, climate: DataFrame, keys: list[str], seasons: list[str], drivers: list[str], first: int, last: int, length: int = 3) -> DataFrame:
    """Per season the trend of its share over windows (panel 'trend') and its fit on each driver's anomaly (panel named as the driver).

    contrib has window_start and a column per season; climate has keys, season, year and the drivers. An anomaly is the
    mean difference of the cells' window means from their own means, in standard deviations of these.
    """
    by, own = ["season", "window_start"], [*keys, "season"]
    shared = season_shares(contrib, "window_start", seasons)
    beside = climate.na.drop(subset=own).withColumns({f"{c}_base": F.avg(c).over(Window.partitionBy(*own)) for c in drivers})  # over a cell's years
    windows = sliding_windows(beside, [*own, *(f"{c}_base" for c in drivers)], "year", drivers, first, last, length)
    z = windows.groupBy(*by).agg(*(F.try_divide(F.avg(F.col(c) - F.col(f"{c}_base")), F.stddev_samp(f"{c}_base")).alias(c) for c in drivers))
    fits = shared.join(z, by).select("season", "share", *drivers).unpivot(["season", "share"], drivers, "panel", "x")
    trends = shared.select("season", "share", F.lit("trend").alias("panel"), F.col("window_start").cast("double").alias("x"))
    return trend(fits.unionByName(trends), ["season", "panel"], "x", "share")


def dependence_grid(df: DataFrame, by: list[str], drivers: list[str], contributions: list[str], points: int = 100) -> DataFrame:
    """dependence_fit() of every contribution on every driver, named in columns `season` and `driver`.

    A driver's values are counted for all contributions in one row.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    tall = df.select(*by, *drivers, *contributions).unpivot([*by, *contributions], drivers, "driver", "f").where(known("f"))
    counts = tall.groupBy(*by, "driver", "f").agg(*(F.count(F.when(known(c), 1)).alias(c) for c in contributions))
    counts = counts.unpivot([*by, "driver", "f"], contributions, "season", "_c").where("_c > 0")
    long = df.select(*by, *drivers, *contributions).unpivot([*by, *drivers], contributions, "season", "c").unpivot([*by, "season", "c"], drivers, "driver", "f")
    return dependence_fit(long, [*by, "driver", "season"], "f", "c", points, counts)


def season_histograms(cells: DataFrame, season: str, value: str, low: float, high: float, bins: int = 40) -> DataFrame:
    """Density per season and bin on one common range."""
    counts = cells.select(season, bin_of(F.col(value), low, high, bins).alias("bin")).where("bin is not null").groupBy(season, "bin").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(season))  # over a season's bins
    return counts.withColumn("density", F.col("n") / whole / ((high - low) / bins))


def season_classes(cells: DataFrame, season: str, value: str, k: int = 5) -> DataFrame:
    """Cells of each season by natural classes of all seasons' values, with each class's range."""
    named = cells.where(F.col(value).isNotNull())
    of = classed(F.col(value), natural_breaks(named, value, k))
    return named.groupBy(season, of.alias("class")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
