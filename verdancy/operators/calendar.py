"""Seasons as intervals of month and day, year windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdancy.session import clustered

#: season -> intervals (first month * 100 + day, last, shift of the year the day counts for)
SEASONS: dict[str, list[tuple[int, int, int]]] = {
    "annual": [(101, 1231, 0)],
    "spring": [(301, 531, 0)],
    "summer": [(601, 831, 0)],
    "autumn": [(901, 1130, 0)],
    "winter": [(101, 229, 0), (1201, 1231, 0)],
    "winter_cross": [(1201, 1231, 0), (101, 228, -1)],
    "winter_short": [(1201, 1231, 0), (101, 220, -1)],
    "summer_half": [(401, 930, 0)],
    "winter_half": [(1001, 1231, 0), (101, 330, -1)],
    "winter_half_long": [(1001, 1231, 0), (101, 331, -1)],
    "chilling": [(1101, 1231, 0), (101, 228, -1)],
}


def segments(seasons: list[str]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Stretches of the year between all edges of the seasons: first month * 100 + day, the first after it, and (season number, shift) of the seasons that hold it."""
    edges = sorted({e for s in seasons for a, b, _ in SEASONS[s] for e in (a, b + 1)})
    return [(lo, hi, [(k, shift) for k, s in enumerate(seasons) for a, b, shift in SEASONS[s] if a <= lo and hi <= b + 1]) for lo, hi in zip(edges, edges[1:], strict=False)]


def segment_sums(df: DataFrame, keys: list[str], ts: str, values: list[str], seasons: list[str]) -> DataFrame:
    """Per key, year and segment: sum_<value> and n_<value> of each value. They can be added up, over batches and into seasons."""
    found = segments(seasons)
    day = F.month(ts) * 100 + F.dayofmonth(ts)
    number = sum(((day >= lo).cast("int") for lo, _, _ in found), F.lit(-1))
    held = F.lit(False)
    for lo, hi, own in found:
        if own:
            held = held | ((day >= lo) & (day < hi))
    rows = df.where(held).select(*keys, F.year(ts).alias("year"), number.alias("segment"), *values)
    return rows.groupBy(*keys, "year", "segment").agg(*(a for v in values for a in (F.sum(v).alias(f"sum_{v}"), F.count(v).alias(f"n_{v}"))))


def seasons_of(sums: DataFrame, keys: list[str], values: list[str], seasons: list[str]) -> DataFrame:
    """Mean of each value per key, season and season year from segment_sums(), which may have several rows for a segment."""
    of = F.array(*(F.array(*(F.struct(F.lit(k).alias("season"), F.lit(shift).alias("shift")) for k, shift in own)) if own else F.array().cast("array<struct<season:int,shift:int>>") for _, _, own in segments(seasons)))
    dealt = sums.select(*keys, F.inline(F.element_at(of, F.col("segment") + 1)), "year", *(f"{a}_{v}" for v in values for a in ("sum", "n")))
    dealt = dealt.withColumn("season_year", F.col("year") + F.col("shift"))
    means = dealt.groupBy(*keys, "season", "season_year").agg(*(F.try_divide(F.sum(f"sum_{v}"), F.sum(f"n_{v}")).alias(v) for v in values))
    name = F.element_at(F.array(*map(F.lit, seasons)), F.col("season") + 1)
    return means.select(*keys, name.alias("season"), "season_year", *values)


def seasonal_means(df: DataFrame, keys: list[str], ts: str, values: list[str], seasons: list[str]) -> DataFrame:
    """Mean of each value per key, season and season year; missing values are left out.

    Rows are added up by the segments between season edges, whatever the number of seasons, and seasons from these. A
    key's rows meet in one of many tasks before that: nearly each row may be a group of its own.
    """
    rows = clustered(df.select(*keys, ts, *values), *keys)
    return seasons_of(segment_sums(rows, keys, ts, values, seasons), keys, values, seasons)


def same_year_winter(df: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """Mean over January, February and December of one and the same year."""
    winter = df.where(F.month(ts).isin(1, 2, 12)).withColumn("year", F.year(ts))
    return winter.groupBy(*keys, "year").agg(*(F.avg(v).alias(v) for v in values))


def sliding_windows(df: DataFrame, keys: list[str], year: str, values: list[str], first: int, last: int, length: int = 3) -> DataFrame:
    """Means over every window of `length` years that lies in first..last: each year is dealt to the windows that hold it."""
    starts = F.sequence(F.greatest(F.lit(first), F.col(year) - length + 1), F.least(F.lit(last - length + 1), F.col(year)))
    inside = df.where(F.col(year).between(first, last)).where(F.greatest(F.lit(first), F.col(year) - length + 1) <= F.least(F.lit(last - length + 1), F.col(year)))
    rows = inside.select("*", F.explode(starts).alias("window_start"))
    return rows.groupBy(*keys, "window_start").agg(*(F.avg(v).alias(v) for v in values)).withColumn("window_end", F.col("window_start") + length - 1)


def pooled_window(year, first: int, last: int, length: int = 3):
    """Number of the tumbling window of a year in first..last (last left out); the remainder belongs to the last window."""
    groups = max((last - first) // length, 1)
    return F.least(F.floor((year - first) / length), F.lit(groups - 1)).cast("int")
