"""Filters and cleaning steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdancy.functions.scalars import drought_phase
from verdancy.schema import nan_to_null
from verdancy.session import written

GROUPS = 100_000  # rows of a summary that is broadcast


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null or NaN, in the given columns (all by default)."""
    return nan_to_null(df.select(*columns) if columns else df).na.drop("any")


def renamed_by_pattern(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnsRenamed({c: c.replace(old, new) for c in df.columns if old in c})


def season_columns(df: DataFrame, suffix: str = "") -> dict[str, str]:
    """Season -> the column of df that names it best: exact season word, then the wanted suffix, then the shortest name."""
    found = {}
    for season in ("spring", "summer", "autumn", "winter"):
        scored = [(3 * (season in c.lower().split("_")) + 2 * (season in c.lower()) + (suffix != "" and c.endswith(suffix)), -len(c), c) for c in df.columns if season in c.lower()]
        if scored:
            found[season] = max(scored)[2]
    return found


def cropped(df: DataFrame, west: float, east: float, south: float, north: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.where(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def masked(df: DataFrame, mask: DataFrame, on: list[str], keep: str = "keep") -> DataFrame:
    """Rows whose cell the mask keeps (1)."""
    return df.join(mask.where(F.col(keep) == 1).select(*on).distinct(), on, "left_semi")


def cropped_and_masked(df: DataFrame, mask: DataFrame, on: list[str], box: tuple[float, float, float, float], value: str, nodata: list[float]) -> DataFrame:
    """Crop to a box and keep every cell of it; what the mask leaves out or the type's fill values mark is null."""
    kept = mask.where("keep = 1").select(*on, F.lit(1).alias("_in")).distinct()
    inside = cropped(df, *box).join(kept, on, "left")
    return inside.withColumn(value, F.when(F.col("_in").isNotNull() & ~F.col(value).isin(*nodata), F.col(value))).drop("_in")


def drought_split(df: DataFrame, target: str, others: list[str], label: str = "phase") -> DataFrame:
    """Rows that are in drought or normal in the target season while the other seasons are not dry; the rest is left out."""
    return df.withColumn(label, drought_phase(target, *others)).where(F.col(label).isNotNull())


def beside_groups(df: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of a summary that has a row for each group. The summary is written and counted; up to GROUPS rows it is broadcast, so that df isn't shuffled by few groups."""
    summary = written(summary)
    if not by:
        return df.crossJoin(F.broadcast(summary))  # one row
    return df.join(F.broadcast(summary) if summary.count() <= GROUPS else summary, by)


def drought_threshold(df: DataFrame, value: str, by: list[str], q: float = 0.25, ranked: bool = True) -> DataFrame:
    """Quantile q of the values above each group's minimum."""
    low = df.groupBy(*by).agg(F.min(value).alias("_low"))
    return quantiles(beside_groups(df, low, by).where(F.col(value) > F.col("_low")), value, by, {"threshold": q}, ranked)


def ranked_quantiles(df: DataFrame, value: str, by: list[str], qs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of groups of any size: rows are ranged by group and value, ranks come from counts per range.

    percentile() keeps a group's distinct values in one task; here a group spreads over as many tasks as it needs, and
    only the two rows around each quantile are gathered. Equal values are counted as one row, so a frequent value is
    no large range.
    """
    return counted_quantiles(ranged(value_counts(df, value, by), value, by), value, by, qs)


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """How often (_c) each value is in its group."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))


def ranged(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Counts by ranges of group and value (_pid), written, because the ranges must be the same wherever they are read."""
    return written(counts.repartitionByRange(*by, value).withColumn("_pid", F.spark_partition_id()))


def counted_quantiles(counted: DataFrame, value: str, by: list[str], qs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of groups from all or some rows of ranged()."""
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ranges = counted.groupBy(*by, "_pid").agg(F.sum("_c").alias("_n"))
    before = ranges.withColumn("_before", F.sum("_n").over(own.orderBy("_pid")) - F.col("_n")).withColumn("_all", F.sum("_n").over(own)).drop("_n")
    upto = F.sum("_c").over(Window.partitionBy(*by, "_pid").orderBy(value))
    placed = counted.join(before, [*by, "_pid"]).withColumn("_hi", F.col("_before") + upto).withColumn("_lo", F.col("_hi") - F.col("_c"))
    out = []
    for name, q in qs.items():
        at = F.lit(float(q)) * (F.col("_all") - 1)
        holds = lambda k: (F.col("_lo") <= k) & (k < F.col("_hi"))
        low, high = F.max(F.when(holds(F.floor(at)), F.col(value))), F.max(F.when(holds(F.ceil(at)), F.col(value)))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*by).agg(*out)


def quantiles(df: DataFrame, value: str, by: list[str], qs: dict[str, float], ranked: bool = False) -> DataFrame:
    """Quantiles per group; ranked for groups whose distinct values may not fit into one task."""
    if ranked:
        return ranked_quantiles(df, value, by, qs)
    return df.groupBy(*by).agg(*(F.percentile(value, q).alias(name) for name, q in qs.items()))


def outer_quantiles(df: DataFrame, value: str, by: list[str], low: float = 0.25, high: float = 0.75, ranked: bool = True) -> DataFrame:
    """Rows at or below the low, or at or above the high quantile of their group; one row of quantiles per group is joined."""
    q = quantiles(df, value, by, {"_lo": low, "_hi": high}, ranked)
    joined = beside_groups(df, q, by)
    return joined.where((F.col(value) <= F.col("_lo")) | (F.col(value) >= F.col("_hi"))).drop("_lo", "_hi")


def median_split(df: DataFrame, value: str, by: list[str], label: str = "half", overlap: bool = False, ranked: bool = True) -> DataFrame:
    """Rows marked low (below the group's median) or high (at or above it); with overlap, ties are in both."""
    q = quantiles(df, value, by, {"_m": 0.5}, ranked)
    joined = beside_groups(df, q, by).where(F.col(value).isNotNull())
    if overlap:
        both = F.array_compact(F.array(F.when(F.col(value) <= F.col("_m"), "low"), F.when(F.col(value) >= F.col("_m"), "high")))
        return joined.withColumn(label, F.explode(both)).drop("_m")
    return joined.withColumn(label, F.when(F.col(value) < F.col("_m"), "low").otherwise("high")).drop("_m")


def outer_halves(df: DataFrame, value: str, by: list[str], counts: DataFrame | None = None, low: float = 0.25, high: float = 0.75, label: str = "half") -> DataFrame:
    """median_split() of outer_quantiles(). The group's value_counts(), or counts if they are known, tell the quantiles and the median of what is left, so df is read once more only."""
    counted = ranged(counts if counts is not None else value_counts(df, value, by), value, by)
    outer = lambda rows: rows.where((F.col(value) <= F.col("_lo")) | (F.col(value) >= F.col("_hi")))
    q = written(counted_quantiles(counted, value, by, {"_lo": low, "_hi": high}))
    m = counted_quantiles(outer(beside_groups(counted, q, by)).select(*by, value, "_c", "_pid"), value, by, {"_m": 0.5})
    joined = outer(beside_groups(df, q.join(m, by) if by else q.crossJoin(m), by))
    return joined.withColumn(label, F.when(F.col(value) < F.col("_m"), "low").otherwise("high")).drop("_lo", "_hi", "_m")


def covers_event(start: str, end: str, event: str, years: int) -> Column:
    """Whether a period reaches at least `years` years of 365 days before and after an event."""
    day = F.to_date(F.lit(event))
    return (F.to_date(start) <= F.date_sub(day, 365 * years)) & (F.to_date(end) >= F.date_add(day, 365 * years))


def complete_stations(records: DataFrame, allowed: int = 2, phase: int | str | None = None, station: str = "s_id", year: str = "year") -> DataFrame:
    """Stations of which at most `allowed` years between their first and last record are missing."""
    rows = records if phase is None else records.where(F.col("phase_id") == F.lit(phase))
    spans = rows.groupBy(station).agg((F.max(year) - F.min(year) + 1 - F.count_distinct(year)).alias("missing"))
    return spans.where(F.col("missing") <= allowed)
