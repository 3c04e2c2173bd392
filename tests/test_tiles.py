"""Cubes of tiles against the same work on pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdancy.operators.grid import coarsened
from verdancy.operators.tiles import blocks_of, coarsened_tiles, masked_tiles, on_tiles, tiled, untiled, write_cube


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(b, r, c, None if (r * c) % 7 == 1 else float((b + 3 * r + c) % 11)) for b in (1, 2) for r in range(-3, 29) for c in range(19) if (r + c + b) % 9]
    return spark.createDataFrame(rows, "band int, row int, col int, v double").cache()


def rows(df):
    return {(r.band, r.row, r.col): r.v for r in df.collect()}


def test_pixels_come_back(pixels):
    tiles = tiled(pixels, ["band"], "v", 12)
    assert rows(untiled(tiles, ["band"], "v", 12)) == {k: v for k, v in rows(pixels).items() if v is not None}
    assert {len(r.cells) for r in tiles.collect()} == {144} and tiled(pixels.limit(0), ["band"], "v", 12).collect() == []
    twice = pixels.union(pixels.withColumn("v", F.col("v") - 1))
    assert rows(untiled(tiled(twice, ["band"], "v", 12), ["band"], "v", 12)) == {k: v for k, v in rows(pixels).items() if v is not None}


def test_blocks_equal_those_of_pixels(pixels):
    inside = pixels.where("row >= 0")
    tiles = coarsened_tiles(tiled(inside, ["band"], "v", 12), 4, 6, size=12)
    got = rows(blocks_of(tiles, ["band"], "v", 4, 6, 12))
    expected = {k: v for k, v in rows(coarsened(inside, ["band"], ["v"], 4, 6, 1000, 1002)).items() if v is not None}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], v, rel_tol=1e-12) for k, v in expected.items())
    assert "Exchange" not in coarsened_tiles(tiled(inside, ["band"], "v", 12), 4, 6, size=12)._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    with pytest.raises(ValueError, match="don't part"):
        coarsened_tiles(tiles, 5, 6, size=12)


def test_masks_join_tiles(pixels):
    mask = pixels.where("band = 1").select("row", "col", (F.col("row") % 3 == 0).cast("int").alias("keep"))
    got = rows(untiled(masked_tiles(tiled(pixels, ["band"], "v", 12), tiled(mask, [], "keep", 12)), ["band"], "v", 12))
    assert got == rows(pixels.join(mask.where("keep = 1"), ["row", "col"]).where("v is not null"))


def test_kernels_and_bands(spark, pixels, tmp_path):
    tiles = tiled(pixels, ["band"], "v", 12)
    write_cube(tiles, str(tmp_path / "cube"), ["band"])
    write_cube(on_tiles(tiles.where("band = 2"), lambda x: np.where(x > 5, x, np.nan), 12), str(tmp_path / "cube"), ["band"])
    cube = spark.read.parquet(str(tmp_path / "cube"))
    assert rows(untiled(cube, ["band"], "v", 12)) == {k: v for k, v in rows(pixels).items() if v is not None and (k[0] == 1 or v > 5)}
