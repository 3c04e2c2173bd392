"""Cubes as tiles: one row holds a square of cells of one band as an array, so that work on cells moves tiles, not pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 120  # cells of a side: divisible by most factors, some 100 KB of doubles


def tiled(df: DataFrame, keys: list[str], value: str, size: int = TILE) -> DataFrame:
    """Pixels (keys, row, col, value) as tiles: keys, trow, tcol and `cells`, size x size values row by row, null where there is no pixel. A cell of several pixels has the largest."""
    place = (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int")
    at = df.where(F.col(value).isNotNull()).select(*keys, F.floor(F.col("row") / size).cast("int").alias("trow"), F.floor(F.col("col") / size).cast("int").alias("tcol"), place.alias("_k"), F.col(value).cast("double").alias("_v"))
    held = at.groupBy(*keys, "trow", "tcol").agg(F.sort_array(F.collect_list(F.struct("_k", "_v"))).alias("pixels"))  # a tile's pixels

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pixels = batch.column("pixels")[k].values
                cells = np.full(size * size, np.nan)
                cells[pixels.field("_k").to_numpy()] = pixels.field("_v").to_numpy()  # the last of equal places, which is the largest
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in [*keys, "trow", "tcol"]), pa.array([pa.array(cells, from_pandas=True)], pa.list_(pa.float64()))], [*keys, "trow", "tcol", "cells"])

    schema = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in [*keys, "trow", "tcol"]) + ", cells array<double>"
    return held.mapInArrow(fill, schema)


def untiled(tiles: DataFrame, keys: list[str], value: str, size: int = TILE) -> DataFrame:
    """Tiles as pixels; cells without a value have no row."""
    rows = tiles.select(*keys, "trow", "tcol", F.posexplode("cells").alias("_k", value)).where(F.col(value).isNotNull())
    return rows.select(*keys, (F.col("trow") * size + F.floor(F.col("_k") / size)).cast("int").alias("row"), (F.col("tcol") * size + F.col("_k") % size).cast("int").alias("col"), value)


def write_cube(tiles: DataFrame, path: str, band: list[str]) -> None:
    """Tiles in a folder for each band, ordered by place, so that a crop reads few row groups; bands that are there already and come again are replaced."""
    tiles.repartition(*band, "trow").sortWithinPartitions("trow", "tcol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*band).parquet(path)


def masked_tiles(tiles: DataFrame, mask: DataFrame) -> DataFrame:
    """Values where the mask's tile (trow, tcol, cells) is 1, else null; tiles without a mask are left out."""
    m = mask.select("trow", "tcol", F.col("cells").alias("_m"))
    keep = F.zip_with("cells", "_m", lambda v, k: F.when(k == 1, v))
    return tiles.join(m, ["trow", "tcol"]).withColumn("cells", keep).drop("_m")


def on_tiles(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], size: int = TILE) -> DataFrame:
    """Tiles under a numpy kernel that takes size x size values, NaN where there are none, and gives an array of any shape; NaN becomes null."""
    kept = [c for c in tiles.columns if c != "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cells = np.asarray(batch.column("cells")[k].values.to_numpy(zero_copy_only=False), float).reshape(size, size)
                out = np.asarray(kernel(cells), float).ravel()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in kept), pa.array([pa.array(out, from_pandas=True)], pa.list_(pa.float64()))], [*kept, "cells"])

    schema = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in kept) + ", cells array<double>"
    return tiles.select(*kept, "cells").mapInArrow(run, schema)


def coarsened_tiles(tiles: DataFrame, fr: int, fc: int, how: str = "avg", size: int = TILE) -> DataFrame:
    """Blocks of fr x fc cells within tiles, whose side both factors divide: mean of the values there are, or their sum. Tiles become smaller; nothing is shuffled."""
    if size % fr or size % fc:
        raise ValueError(f"blocks of {fr} x {fc} don't part a tile of {size}")

    def kernel(cells: np.ndarray) -> np.ndarray:
        blocks = cells.reshape(size // fr, fr, size // fc, fc)
        n = (~np.isnan(blocks)).sum((1, 3))
        total = np.nansum(blocks, (1, 3))
        return np.where(n > 0, total / np.maximum(n, 1) if how == "avg" else total, np.nan)

    return on_tiles(tiles, kernel, size)


def blocks_of(tiles: DataFrame, keys: list[str], value: str, fr: int, fc: int, size: int = TILE) -> DataFrame:
    """Coarsened tiles as coarse cells: keys, row, col, value."""
    rows = tiles.select(*keys, "trow", "tcol", F.posexplode("cells").alias("_k", value)).where(F.col(value).isNotNull())
    wide = size // fc
    return rows.select(*keys, (F.col("trow") * (size // fr) + F.floor(F.col("_k") / wide)).cast("int").alias("row"), (F.col("tcol") * wide + F.col("_k") % wide).cast("int").alias("col"), value)
