"""Whole analyses, each one lazy chain of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdancy.functions.scalars import absolute_share, scaled
from verdancy.operators.aggregates import baseline, symmetric_limit, whisker_summary, zonal_profile
from verdancy.operators.calendar import same_year_winter, seasonal_means, sliding_windows
from verdancy.operators.cleaning import cropped, season_columns
from verdancy.operators.grid import GridSpec, category_at, coarsened, mosaic, nearest_valid, support
from verdancy.operators.reshape import anomaly, long_to_wide, tagged_union, update_join
from verdancy.operators.trends import trend, window_anomaly


def summarize_cells(obs: DataFrame, mask: DataFrame, ts: str, values: list[str], seasons: list[str], size: tuple[int, int], factor: tuple[int, int], more_than: int = 1) -> DataFrame:
    """Seasonal means of masked pixels, coarsened to cells with weights; cells with little support are left out."""
    kept = mask.where("keep = 1").select("row", "col")
    seasonal = seasonal_means(obs.join(kept, ["row", "col"], "left_semi"), ["row", "col"], ts, values, seasons)
    cells = coarsened(seasonal, ["season", "season_year"], values, *factor, *size)
    weights = support(mask, [], "keep", *factor, *size, more_than=more_than)
    return cells.join(weights.select("row", "col", "weights"), ["row", "col"])


def wide_summary(cells: DataFrame, years: list[int], seasons: list[str], values: list[str]) -> DataFrame:
    """One row per cell with a column <value>_<season>_<year>; years and seasons are given."""
    named = cells.select("row", "col", "weights", "season", "season_year", *values)
    out = named.groupBy("row", "col", "weights")
    return out.agg(*(F.max(F.when((F.col("season") == s) & (F.col("season_year") == y), F.col(v))).alias(f"{v}_{s}_{y}") for v in values for s in seasons for y in years))


def add_factors(summary: DataFrame, factors: DataFrame) -> DataFrame:
    """Further factor columns for the cells of a summary, joined by cell."""
    return summary.join(factors, ["row", "col"], "left")


def repair_winter(summary: DataFrame, obs: DataFrame, keys: list[str], ts: str, value: str, column: str) -> DataFrame:
    """A summary's winter column replaced by the same-year winter mean where there is one."""
    fresh = same_year_winter(obs, [k for k in keys if k != "year"], ts, [value]).withColumnRenamed(value, column)
    return update_join(summary, fresh, keys, [column])


def pixel_summary(shares: DataFrame, seasonal: DataFrame, years: list[int], values: list[str]) -> DataFrame:
    """Pixels as they are: dominant class and a column for each value and year."""
    return shares.select("row", "col", "dominant").join(long_to_wide(seasonal, ["row", "col"], "season_year", years, values), ["row", "col"])


def tag_regions(cells: DataFrame, grid: DataFrame, spec: GridSpec, x: str, y: str, invalid: int = 15, radius: int | None = None) -> DataFrame:
    """Region of each cell; cells on an invalid region take the nearest valid one, cells off the grid have none."""
    return category_at(cells, nearest_valid(grid, "region_id", invalid, radius), spec, x, y, "region_id")


def union_countries(parts: dict[str, DataFrame]) -> DataFrame:
    return tagged_union(parts, "country")


def anomaly_maps(annual: DataFrame, keys: list[str], value: str, size: tuple[int, int], factor: tuple[int, int]) -> DataFrame:
    """Yearly anomalies from each pixel's own mean, coarsened."""
    return coarsened(anomaly(annual, keys, value), ["year"], ["anomaly"], *factor, *size)


def trend_anomaly_grid(contrib: DataFrame, yearly: DataFrame, keys: list[str], season: str, shares: list[str], climate: list[str], first: int, last: int, length: int = 3) -> DataFrame:
    """Per season: trend of its mean absolute share over windows, beside the climate's anomaly trends."""
    shared = contrib.select("window_start", absolute_share(season, *shares).alias("share")).groupBy("window_start").agg(F.avg("share").alias("share"))
    out = trend(shared, [], "window_start", "share").select(F.lit("share").alias("what"), "slope", "ci_low", "ci_high")
    windows = sliding_windows(yearly, keys, "year", climate, first, last, length)
    for c in climate:
        z = window_anomaly(windows, yearly, keys, c, ["window_start"])
        out = out.unionByName(trend(z, [], "window_start", "z").select(F.lit(c).alias("what"), "slope", "ci_low", "ci_high"))
    return out


def sensitivity_panel(contrib: DataFrame, region: str, suffix: str = "shap_value") -> DataFrame:
    """Shares of the season columns per region: whiskers, and the difference of each mean from the overall mean."""
    seasons = season_columns(contrib, suffix)
    long = contrib.select(region, *(absolute_share(c, *seasons.values()).alias(s) for s, c in seasons.items())).unpivot([region], list(seasons), "season", "share")
    own = whisker_summary(long, [region, "season"], "share")
    whole = long.groupBy("season").agg(F.avg("share").alias("overall"))
    return own.join(whole, "season").withColumn("delta", F.col("mean") - F.col("overall"))


def panel_limit(panel: DataFrame, region: str) -> DataFrame:
    return symmetric_limit(panel, [region], "delta")


def maps_with_profiles(cells: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Mean and spread along rows and along columns."""
    return zonal_profile(cells, "row", value), zonal_profile(cells, "col", value)


def drought_legacy(contrib: DataFrame, year: str, label: str, lag: str, others: list[str]) -> DataFrame:
    """Lag's percentage among absolute contributions per year, drought against normal, with its standard error."""
    share = absolute_share(lag, lag, *others) * 100
    rows = contrib.select(year, label, share.alias("share"))
    return rows.groupBy(year, label).agg(F.avg("share").alias("mean"), (F.stddev_samp("share") / F.sqrt(F.count("share"))).alias("sem"))


def study_area(cells: DataFrame, counts: DataFrame, value: str, year: int, nodata: float = -9999.0) -> DataFrame:
    """A year's value where support is above the lower quartile of positive counts, else nodata."""
    q = counts.where("n > 0").agg(F.percentile("n", 0.25).alias("q"))
    own = cells.where(F.col("season_year") == year).select("row", "col", value)
    rows = counts.crossJoin(F.broadcast(q)).join(own, ["row", "col"], "left")
    return rows.select("row", "col", F.coalesce(F.when(F.col("n") > F.col("q"), F.col(value)), F.lit(nodata)).alias(value))


def phenology_stack(records: DataFrame, bands: dict[int, str]) -> DataFrame:
    """Phases (by band) as day of the year per pixel and year, and their long-term means."""
    days = records.withColumn("phase", F.element_at(F.create_map(*(F.lit(x) for kv in bands.items() for x in kv)), F.col("band"))).where("phase is not null")
    days = days.withColumn("doy", F.dayofyear(F.date_from_unix_date("days_since_1970")))
    return days.join(baseline(days, ["row", "col", "phase"], "doy"), ["row", "col", "phase"]).select("row", "col", "year", "phase", "doy", "baseline")


def cleaned_observations(raw: DataFrame, value: str, box: tuple[float, float, float, float]) -> DataFrame:
    return cropped(raw, *box).withColumn(value, scaled(value))


def merged_tiles(tiles: DataFrame, value: str, order: str) -> DataFrame:
    return mosaic(tiles, ["row", "col"], value, order)
