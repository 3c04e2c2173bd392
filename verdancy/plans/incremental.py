"""Summaries that grow by batches of observations: what a batch adds is computed once, and only the windows that it touches are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.operators.calendar import seasons_of, segment_sums
from verdancy.sources.commits import Batches
from verdancy.sources.tables import write_partitions


class SeasonalSummary:
    """Seasonal means of cells over committed batches, and means over sliding windows of years.

    A batch is kept as sums and counts by key, year and segment of the year, which add up over batches and seasons. A
    repeated commit changes nothing; one that breaks off before its end leaves no trace in any result. Keys are of
    integer type.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], values: list[str], seasons: list[str]):
        self.spark, self.folder, self.keys, self.values, self.seasons = spark, folder.rstrip("/"), keys, values, seasons
        columns = [*(f"`{k}` int" for k in keys), "year int", "segment int", *(f"`sum_{v}` double, `n_{v}` long" for v in values)]
        self.batches = Batches(spark, f"{self.folder}/sums", ", ".join(columns))
        self.windowed = f"{self.folder}/windows"

    def add(self, batch: str, obs: DataFrame, ts: str) -> bool:
        """Commits the sums of a batch of observations, unless a batch of this name is there."""
        sums = segment_sums(obs, self.keys, ts, self.values, self.seasons)
        cast = [*(F.col(k).cast("int").alias(k) for k in [*self.keys, "year", "segment"]), *(F.col(f"{a}_{v}").cast(t).alias(f"{a}_{v}") for v in self.values for a, t in (("sum", "double"), ("n", "long")))]
        return self.batches.put(batch, sums.select(*cast), again=False)

    def means(self) -> DataFrame:
        """Mean of each value per key, season and season year over all batches."""
        return seasons_of(self.batches.read(), self.keys, self.values, self.seasons)

    def _touched(self, batches: list[str] | None, first: int, last: int, length: int) -> list[int]:
        """Starts of the windows that hold a season year of the batches; a batch of year y has seasons of y - 1 and y. At most as many as there are windows."""
        starts = range(first, last - length + 2)
        if batches is None:
            return list(starts)
        own = self.batches.committed()
        paths = [f"{self.batches.folder}/data/{own[b].split('-')[1]}" for b in batches if b in own]
        if not paths:
            return []
        sums = self.spark.read.schema(self.batches.schema).parquet(*paths)
        years = {r["season_year"] for r in seasons_of(sums, [], self.values, self.seasons).select("season_year").distinct().collect()}
        return [s for s in starts if any(s <= y < s + length for y in years)]

    def refresh(self, first: int, last: int, length: int = 3, batches: list[str] | None = None) -> list[int]:
        """Writes the means of sliding windows in first..last again: those that hold years of the given batches, or all. Returns their starts."""
        starts = self._touched(batches, first, last, length)
        if starts:
            low, high = min(starts), max(starts) + length - 1
            means = self.means().where(F.col("season_year").between(low, high))
            dealt = means.withColumn("window_start", F.explode(F.array(*map(F.lit, starts)))).where(F.col("season_year").between(F.col("window_start"), F.col("window_start") + length - 1))
            write_partitions(dealt.groupBy(*self.keys, "season", "window_start").agg(*(F.avg(v).alias(v) for v in self.values)), self.windowed, ["window_start"])
        return starts

    def windows(self) -> DataFrame:
        """The windows as they were last written."""
        return self.spark.read.parquet(self.windowed)
