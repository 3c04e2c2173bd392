"""Nearest cells and nearest values on an axis, however far, against plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdancy.operators import grid as module
from verdancy.operators.grid import nearest_irregular, nearest_valid
from verdancy.operators.ordered import carried


def plain(cells, invalid=15):
    valid = np.array([(r, c, v) for r, c, v in cells if v != invalid])
    out = {}
    for r, c, v in cells:
        if v != invalid:
            out[r, c] = v
        else:
            d = (valid[:, 0] - r) ** 2 + (valid[:, 1] - c) ** 2
            out[r, c] = int(valid[np.lexsort((valid[:, 1], valid[:, 0], d))[0], 2])
    return out


def got(spark, cells, radius=None):
    return {(r.row, r.col): r.id for r in nearest_valid(spark.createDataFrame(cells, "row int, col int, id int"), "id", 15, radius).collect()}


def test_no_cell_is_too_far(spark):
    cells = [(r, c, 15) for r in range(20) for c in range(3) if (r, c) not in ((0, 0), (19, 2))] + [(0, 0, 4), (19, 2, 7)]
    assert got(spark, cells) == plain(cells)
    assert set(got(spark, [(0, 0, 15), (1, 1, 15)]).values()) == {None}
    assert got(spark, [(0, 0, 15), (3, 4, 1)], 4) == {(0, 0): None, (3, 4): 1} and got(spark, [(0, 0, 15), (3, 4, 1)], 5)[0, 0] == 1


def test_a_hole_200_wide(spark):
    cells = [(r, c, 15 if 10 <= r < 210 and 5 <= c < 205 else (r * 7 + c) % 13) for r in range(220) for c in range(210)]
    assert got(spark, cells) == plain(cells)


@pytest.mark.parametrize("seed", range(3))
def test_sparse_grids_with_ties(spark, monkeypatch, seed):
    monkeypatch.setattr(module, "BAND", 4)
    r = random.Random(seed)
    cells = [(i - 9, j - 5, 15 if r.random() < 0.93 else r.randrange(1, 9)) for i in range(30) for j in range(24) if r.random() < 0.8]
    assert got(spark, cells) == plain(cells)


def test_axis_of_a_million_values(spark):
    axis = spark.range(1_000_000).select((F.col("id") * 3 + F.pmod(F.xxhash64("id"), F.lit(3))).cast("double").alias("pos"))
    points = spark.range(3000).select("id", ((F.pmod(F.xxhash64("id", F.lit(7)), F.lit(6_002_000)) - 1000) / 2).alias("x")).union(spark.sql("select -1L, cast(null as double)"))
    found = {r.id: (r.x, r.near) for r in nearest_irregular(points, axis, "x", "pos", "near").collect()}
    known = np.sort(np.array([r.pos for r in axis.collect()]))
    assert len(found) == 3001 and found.pop(-1) == (None, None)
    for x, near in found.values():
        d = np.abs(known[max(0, np.searchsorted(known, x) - 3) : np.searchsorted(known, x) + 3] - x)
        assert abs(near - x) == d.min() and (near >= x or (np.abs(known - x) == d.min()).sum() == 1)


def test_values_are_carried_over_blocks(spark):
    rows = [(k, i, float(i) if i % 17 == k else None) for k in range(3) for i in range(100)] + [(9, 1, None)]
    df = carried(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], "i", "v", F.floor(F.col("i") / 5))
    for r in df.collect():
        known = [] if r.k == 9 else [i for i in range(100) if i % 17 == r.k]
        assert r.before == max((i for i in known if i <= r.i), default=None) and r.after == min((i for i in known if i >= r.i), default=None)
