"""Wide and long tables, unions, samples, runs along a series."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anomaly(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value less the key's long-term mean."""
    return df.withColumn("anomaly", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def zero_crossings(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The series with a point (x0, 0) put in wherever two points in a row differ in sign."""
    w = Window.partitionBy(*keys).orderBy(x)
    before = df.withColumn("_x", F.lag(x).over(w)).withColumn("_y", F.lag(y).over(w))
    cross = before.where(F.col("_y") * F.col(y) < 0)
    at = F.col("_x") + (F.lit(0.0) - F.col("_y")) / (F.col(y) - F.col("_y")) * (F.col(x) - F.col("_x"))
    return df.select(*keys, F.col(x).cast("double").alias(x), y).unionByName(cross.select(*keys, at.alias(x), F.lit(0.0).alias(y)))


def sign_runs(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Runs of points of one sign: key, run number, sign, first and last x, points."""
    w = Window.partitionBy(*keys).orderBy(x)
    s = df.withColumn("sign", F.signum(y).cast("int"))
    s = s.withColumn("run", F.sum(F.when(F.col("sign") == F.lag("sign").over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "run", "sign").agg(F.min(x).alias("first"), F.max(x).alias("last"), F.count("*").alias("points"))


def wide_to_long(df: DataFrame, keys: list[str], pattern: str = r"^(.+)_(\d{4})$", years: range | None = None) -> DataFrame:
    """Columns named <variable>_<year> as rows (key, year) with a column for each variable; the schema alone is read on the driver."""
    found: dict[int, dict[str, str]] = {}
    for c in df.columns:
        if c not in keys and (m := re.match(pattern, c)):
            found.setdefault(int(m[2]), {})[m[1]] = c
    variables = sorted({v for x in found.values() for v in x})
    rows = [F.struct(F.lit(y).alias("year"), *((F.col(found[y][v]) if v in found[y] else F.lit(None)).cast("double").alias(v) for v in variables)) for y in sorted(found) if years is None or y in years]
    return df.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def long_to_wide(df: DataFrame, keys: list[str], year: str, years: list[int], values: list[str]) -> DataFrame:
    """One row per key with a column <value>_<year>; the years are given, so no job lists them."""
    pivoted = df.groupBy(*keys).agg(*(F.max(F.when(F.col(year) == y, F.col(v))).alias(f"{v}_{y}") for v in values for y in years))
    return pivoted


def tagged_union(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """All frames with the name of each as a column; columns that one lacks are null."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _lot(keys: list[str], seed: int) -> Column:
    """A hash of the keys that other engines compute alike."""
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(str(seed))))


def hashed_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows whose keys hash lowest: a sample that is the same on every run and cluster."""
    return df.orderBy(_lot(keys, seed), *keys).limit(n)


def grouped_sample(df: DataFrame, by: list[str], keys: list[str], share: float = 0.07, least: int = 50, seed: int = 42) -> DataFrame:
    """Of each group the rows that hash lowest: `share` of it, `least` at least, all where it is smaller.

    Groups are counted by the hash's first 16 bits; that tells the one cell of 65,536 in which the sample ends. Lower
    cells are in it whole, and only rows of that cell are ranked, so no group comes together in one task.
    """
    lots = df.withColumn("_lot", _lot(keys, seed)).withColumn("_cell", F.conv(F.substring("_lot", 1, 4), 16, 10).cast("int"))
    w = Window.partitionBy(*by)
    cells = lots.groupBy(*by, "_cell").agg(F.count("*").alias("_c"))
    cells = cells.withColumn("_upto", F.sum("_c").over(w.orderBy("_cell"))).withColumn("_n", F.sum("_c").over(w))
    cells = cells.withColumn("_k", F.least("_n", F.greatest(F.lit(least), F.floor(F.col("_n") * share))))
    ends = cells.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_c") < F.col("_k"))).select(*by, F.col("_cell").alias("_end"), (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_rest"))
    reached = lots.join(ends, by).where(F.col("_cell") <= F.col("_end"))
    edge = reached.where(F.col("_cell") == F.col("_end")).withColumn("_rn", F.row_number().over(w.orderBy("_lot", *keys)))
    kept = reached.where(F.col("_cell") < F.col("_end")).unionByName(edge.where(F.col("_rn") <= F.col("_rest")).drop("_rn"))
    return kept.select(*df.columns)


def update_join(df: DataFrame, new: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """df with the given columns taken from matching rows of new where they have a value."""
    fresh = new.select(*on, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = df.join(fresh, on, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def hash_fold(keys: list[str], folds: int = 10, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(folds)).cast("int")


def season_share(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Absolute share of each row's value in its key's sum of absolute values."""
    total = F.sum(F.abs(F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn("share", F.try_divide(F.abs(F.col(value)), total))
