"""Regridding between regular grids whose cells needn't divide each other, by the areas that cells share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdancy.operators.grid import GridSpec

EDGE = 1e-9  # shares of a cell below this are rounding


def _shares(index: Column, fine: tuple[float, float], coarse: tuple[float, float, int]) -> Column:
    """Coarse cells that a fine cell of an axis touches, each with the share of the fine cell in it: an array of (cell, share). Steps may be negative."""
    (at, step), (origin, size, n) = fine, coarse
    a, b = (index * step + (at - origin)) / size, ((index + 1) * step + (at - origin)) / size
    low, high = F.least(a, b), F.greatest(a, b)
    first, last = F.greatest(F.floor(low + EDGE), F.lit(0)), F.least(F.ceil(high - EDGE) - 1, F.lit(n - 1))
    cells = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    share = lambda j: (F.least(high, j + 1.0) - F.greatest(low, j.cast("double"))) / (high - low)
    return F.filter(F.transform(cells, lambda j: F.struct(j.cast("int").alias("cell"), share(j).alias("share"))), lambda x: x["share"] > EDGE)


def overlaps(df: DataFrame, fine: GridSpec, coarse: GridSpec) -> DataFrame:
    """df once for every coarse cell that its fine cell touches: row and col of the coarse cell, and `share`, the part of the fine cell in it. The rows follow from the cell's own numbers, so nothing is joined."""
    rows = df.select("*", F.explode(_shares(F.col("row"), (fine.y0, fine.dy), (coarse.y0, coarse.dy, coarse.rows))).alias("_r"))
    both = rows.select("*", F.explode(_shares(F.col("col"), (fine.x0, fine.dx), (coarse.x0, coarse.dx, coarse.cols))).alias("_c"))
    return both.withColumn("share", F.col("_r.share") * F.col("_c.share")).withColumn("row", F.col("_r.cell")).withColumn("col", F.col("_c.cell")).drop("_r", "_c")


def regridded(df: DataFrame, keys: list[str], values: list[str], fine: GridSpec, coarse: GridSpec, how: str = "avg") -> DataFrame:
    """Values of fine cells on a coarse grid of any real factor; no cell is trimmed.

    avg: the mean over the area that has values. sum: every fine value is dealt to the cells it touches, so totals are
    kept where the coarse grid covers the fine one; missing values count as 0.
    """
    dealt = overlaps(df.select(*keys, "row", "col", *values), fine, coarse)
    weighted = {v: F.sum(F.col(v) * F.col("share")) for v in values}
    area = {v: F.sum(F.when(F.col(v).isNotNull(), F.col("share"))) for v in values}
    out = [F.try_divide(weighted[v], area[v]).alias(v) if how == "avg" else F.coalesce(weighted[v], F.lit(0.0)).alias(v) for v in values]
    return dealt.groupBy(*keys, "row", "col").agg(*out)


def area_weights(df: DataFrame, mask: str, fine: GridSpec, coarse: GridSpec, more_than: float = 0.0) -> DataFrame:
    """Kept area of each coarse cell in fine cells, and its share of the coarse cell's own area, where more than `more_than` fine cells are kept."""
    n = regridded(df, [], [mask], fine, coarse, "sum").withColumnRenamed(mask, "n")
    return n.withColumn("weights", F.col("n") / abs(coarse.dx * coarse.dy / (fine.dx * fine.dy))).where(F.col("n") > more_than)


def class_areas(df: DataFrame, classes: list[int], fine: GridSpec, coarse: GridSpec, cls: str = "cls") -> DataFrame:
    """In each coarse cell, in fine cells: area of the wanted classes, area of all, and the class of most area (the smaller at a tie)."""
    areas = overlaps(df.select("row", "col", cls), fine, coarse).groupBy("row", "col", cls).agg(F.round(F.sum("share"), 9).alias("_a"))
    return areas.groupBy("row", "col").agg(F.sum(F.when(F.col(cls).isin(*classes), F.col("_a")).otherwise(0.0)).alias("wanted"), F.sum("_a").alias("total"), F.max_by(cls, F.struct("_a", -F.col(cls))).alias("dominant"))
