"""Operators on regular grids: lookups by computed index, coarsening, tiles, mosaics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdancy.operators.ordered import carried
from verdancy.session import written

BAND = 1024


@dataclass(frozen=True)
class GridSpec:
    """A regular grid: origin and step of both axes, rows and columns, and a name of its reference system."""

    x0: float
    dx: float
    y0: float
    dy: float
    rows: int
    cols: int
    crs: str = "EPSG:4326"

    def row(self, y: Column) -> Column:
        return F.floor((y - self.y0) / self.dy).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.dx).cast("int")

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.rows - 1) & col.between(0, self.cols - 1)


def nearest_index(x: Column, origin: float, step: float, n: int) -> Column:
    """Index of the nearest of n cell centres origin, origin + step, ...; half way goes to the larger coordinate, beyond the edge to the edge."""
    return F.least(F.greatest(F.floor((x - origin) / step + 0.5), F.lit(0)), F.lit(n - 1)).cast("int")


def nearest_lookup(points: DataFrame, grid: DataFrame, x: str, axis: tuple[float, float, int], index: str) -> DataFrame:
    """Joins points to the grid's nearest cell along one axis by a computed index instead of a range condition."""
    return points.withColumn(index, nearest_index(F.col(x), *axis)).join(grid, index)


def nearest_irregular(points: DataFrame, axis: DataFrame, x: str, at: str, key: str) -> DataFrame:
    """Nearest value of an irregular axis of any length for each point, the larger one half way; null for a null x or an empty axis.

    Distinct values of points and axis are ranged together and written; the last and the next value of the axis are
    carried along and over the borders of ranges. Points then take the result of their value.
    """
    asked = points.select(F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull()).distinct()
    told = axis.select(F.col(at).cast("double").alias("_x")).where(F.col("_x").isNotNull()).distinct()
    both = asked.withColumn("_own", F.lit(None).cast("double")).unionByName(told.withColumn("_own", F.col("_x")))
    ranged = written(both.repartitionByRange("_x").withColumn("_part", F.spark_partition_id()))
    placed = carried(ranged, [], "_x", "_own", F.col("_part")).where("_own is null").select("_x", "before", "after")
    nearest = F.when(F.col("after") - F.col("_x") <= F.col("_x") - F.col("before"), F.col("after")).otherwise(F.coalesce("before", "after"))
    found = placed.select("_x", nearest.alias(key))
    return points.join(found, points[x].cast("double") == found["_x"], "left").drop("_x")


def coarsened(df: DataFrame, keys: list[str], values: list[str], fr: int, fc: int, rows: int, cols: int, how: str = "avg") -> DataFrame:
    """Blocks of fr x fc cells; what the integer factors leave over at the edge is trimmed. how: avg, or sum with missing as 0."""
    inside = df.where((F.col("row") < rows // fr * fr) & (F.col("col") < cols // fc * fc))
    block = [F.floor(F.col("row") / fr).cast("int").alias("row"), F.floor(F.col("col") / fc).cast("int").alias("col")]
    agg = [F.avg(v).alias(v) if how == "avg" else F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]
    return inside.select(*keys, *block, *values).groupBy(*keys, "row", "col").agg(*agg)


def support(df: DataFrame, keys: list[str], mask: str, fr: int, fc: int, rows: int, cols: int, more_than: int = 1) -> DataFrame:
    """Number of kept fine cells in each coarse cell and its share (the cell's weight), where more than `more_than` are kept."""
    n = coarsened(df, keys, [mask], fr, fc, rows, cols, "sum").withColumnRenamed(mask, "n")
    return n.withColumn("weights", F.col("n") / (fr * fc)).where(F.col("n") > more_than)


def footprint(coarse: DataFrame, scale: float, row: str = "row", col: str = "col") -> DataFrame:
    """Fine rows and columns that a coarse pixel touches, both ends in: a pixel of `scale` fine ones may share its edge with the next."""
    span = lambda c: F.sequence(F.floor(F.col(c) * scale).cast("int"), F.floor((F.col(c) + 1) * scale).cast("int"))
    return coarse.withColumn("lrow", F.explode(span(row))).withColumn("lcol", F.explode(span(col)))


def class_share(fine: DataFrame, coarse: DataFrame, scale: float, classes: list[int], cls: str = "cls") -> DataFrame:
    """In each coarse pixel's footprint: cells of the wanted classes, all cells, the commonest class (the smaller at a tie)."""
    joined = footprint(coarse.select("row", "col"), scale).join(fine, ["lrow", "lcol"])
    counts = joined.groupBy("row", "col", cls).agg(F.count("*").alias("n"))
    return counts.groupBy("row", "col").agg(
        F.sum(F.when(F.col(cls).isin(*classes), F.col("n")).otherwise(0)).alias("wanted"),
        F.sum("n").alias("total"),
        F.max_by(cls, F.struct("n", -F.col(cls))).alias("dominant"),
    )


def forest_mask(shares: DataFrame, elevation: DataFrame, share: float = 0.8, highest: float = 800) -> DataFrame:
    """keep = 1 where the wanted classes make up floor(share * total) cells or more and the pixel isn't above `highest`."""
    keep = (F.col("wanted") >= F.floor(F.col("total") * share)) & (F.col("elev") <= highest)
    return shares.join(elevation, ["row", "col"]).withColumn("keep", keep.cast("int"))


def category_at(points: DataFrame, grid: DataFrame, spec: GridSpec, x: str, y: str, value: str) -> DataFrame:
    """Category of the cell a point lies in; null outside the grid."""
    placed = points.withColumn("row", spec.row(F.col(y))).withColumn("col", spec.col(F.col(x)))
    placed = placed.withColumn("row", F.when(spec.inside(F.col("row"), F.col("col")), F.col("row")))
    return placed.join(grid.select("row", "col", value), ["row", "col"], "left")


def _line(row: int, cols: list[int], rows: list[int], asked: list[int]) -> list[int]:
    """Index of the nearest of a line's candidates, candidate k in column cols[k] (ascending) and row rows[k], for each asked column (ascending) of `row`.

    The lower envelope of the squared distances as parabolas over the columns. Ties go to the smaller row, then column:
    their order is added to the distances, which are scaled so that it decides between equal ones only.
    """
    top, width = min(rows), cols[-1] - cols[0] + 1
    scale = (max(rows) - top + 1) * width
    height = [scale * ((r - row) ** 2 + c * c) + (r - top) * width + c - cols[0] for c, r in zip(cols, rows, strict=True)]
    hull, start = [], []  # candidates on the envelope and the first column where each is the nearest
    for k, c in enumerate(cols):
        first = None
        while hull:
            before = hull[-1]
            first = (height[k] - height[before]) // (2 * scale * (c - cols[before])) + 1
            if first > start[-1]:
                break
            hull.pop(), start.pop()
        hull.append(k)
        start.append(first if len(hull) > 1 else min(asked[0], cols[0]) - 1)
    found, at = [], 0
    for c in asked:
        while at + 1 < len(hull) and start[at + 1] <= c:
            at += 1
        found.append(hull[at])
    return found


def nearest_valid(grid: DataFrame, value: str, invalid: int, radius: int | None = None) -> DataFrame:
    """Invalid cells take the valid value at the least distance (ties: smaller row, then column); beyond a radius, where one is given, they have none.

    An exact distance transform in two scans, whose work follows the number of cells however far the nearest valid cell
    is. Along the columns, in bands of BAND rows, the nearest valid cell above and below is carried to every row that
    has invalid cells. Along each of these rows the lower envelope of the columns' distances gives the nearest of all.
    """
    kind = grid.schema[value].dataType.simpleString()
    valid = grid.where(F.col(value) != invalid).select("row", "col", F.struct("row", F.col(value).alias("v")).alias("own"))
    missing = grid.where(F.col(value) == invalid).select("row", "col")
    ends = valid.agg(F.min("col").alias("a"), F.max("col").alias("b"))  # one row
    rows = missing.select("row").distinct().crossJoin(F.broadcast(ends)).where("a is not null")
    asked = rows.select("row", F.explode(F.sequence("a", "b")).alias("col"), F.lit(None).cast(valid.schema["own"].dataType).alias("own"))
    both = carried(asked.unionByName(valid).withColumn("asked", F.col("own").isNull()), ["col"], "row", "own", F.floor(F.col("row") / BAND)).where("asked")
    above = F.col("row") - F.col("before.row") <= F.col("after.row") - F.col("row")
    near = both.select("row", "col", F.when(above, F.col("before")).otherwise(F.coalesce("after", "before")).alias("near")).where("near is not null")
    lines = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "near"))).alias("line"))  # a grid's width at most
    lines = lines.join(missing.groupBy("row").agg(F.sort_array(F.collect_list("col")).alias("asked")), "row")
    lines = lines.select("row", "asked", "line.col", "line.near.row", "line.near.v").toDF("row", "asked", "cols", "rows", "values")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.to_pylist():
                found = _line(line["row"], line["cols"], line["rows"], line["asked"])
                far = [radius is not None and (line["rows"][k] - line["row"]) ** 2 + (line["cols"][k] - c) ** 2 > radius**2 for k, c in zip(found, line["asked"], strict=True)]
                took = [None if f else line["values"][k] for k, f in zip(found, far, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([line["row"]] * len(took), batch.schema.field("row").type), pa.array(line["asked"], batch.schema.field("asked").type.value_type), pa.array(took, batch.schema.field("values").type.value_type)], ["row", "col", value])

    index = {c: grid.schema[c].dataType.simpleString() for c in ("row", "col")}
    found = lines.mapInArrow(scan, f"row {index['row']}, col {index['col']}, `{value}` {kind}")
    kept = grid.where(F.col(value) != invalid).select("row", "col", value)
    return kept.unionByName(missing.join(found, ["row", "col"], "left").select("row", "col", value))


def mosaic(tiles: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Overlapping tiles: the first tile that has a value wins; null only where none has."""
    return tiles.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def block_of(index: Column, size: int, blocks: int, keep_rest: bool = True) -> Column:
    """Tile number along an axis: the last tile keeps the remainder, or cells beyond equal tiles have none."""
    each = max(size // blocks, 1)
    tile = F.floor(index / each).cast("int")
    return F.least(tile, F.lit(blocks - 1)) if keep_rest else F.when(tile < blocks, tile)


def rectangles(west: float, east: float, south: float, north: float, k: int, spark) -> DataFrame:
    """k x k rectangles of a bounding box."""
    i = F.floor(F.col("id") / k).cast("int")
    j = (F.col("id") % k).cast("int")
    dx, dy = (east - west) / k, (north - south) / k
    return spark.range(k * k).select(i.alias("i"), j.alias("j"), (west + i * dx).alias("west"), (west + (i + 1) * dx).alias("east"), (south + j * dy).alias("south"), (south + (j + 1) * dy).alias("north"))


def scaffold(spark, rows: int, cols: int) -> DataFrame:
    """Every cell of a grid; rows are dealt out, so that large grids have many tasks."""
    return spark.range(rows).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))


def to_raster(cells: DataFrame, value: str, rows: int, cols: int, nodata: float) -> DataFrame:
    """Dense grid of a value: cells without a row hold nodata."""
    full = scaffold(cells.sparkSession, rows, cols)
    return full.join(cells.select("row", "col", value), ["row", "col"], "left").withColumn(value, F.coalesce(value, F.lit(nodata)))
