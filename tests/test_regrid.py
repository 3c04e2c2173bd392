"""Regridding by shared areas against sums over all pairs of cells."""

import itertools
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from verdancy.operators.grid import GridSpec, coarsened
from verdancy.operators.regrid import area_weights, class_areas, overlaps, regridded

FINE = GridSpec(10.0, 0.25, 50.0, -0.2, 9, 13)
COARSE = GridSpec(9.9, 0.62, 50.1, -0.55, 5, 7)


def cells(spark, spec=FINE):
    rows = [(r, c, None if (r + c) % 6 == 0 else float((3 * r + 7 * c) % 11), (r * c) % 4) for r in range(spec.rows) for c in range(spec.cols)]
    return rows, spark.createDataFrame(rows, "row int, col int, v double, cls int")


def shared(a, b, spec, coarse, axis):
    at, step, origin, size = (spec.x0, spec.dx, coarse.x0, coarse.dx) if axis else (spec.y0, spec.dy, coarse.y0, coarse.dy)
    one, two = sorted((at + a * step, at + (a + 1) * step)), sorted((origin + b * size, origin + (b + 1) * size))
    return max(0.0, min(one[1], two[1]) - max(one[0], two[0])) / abs(step)


@pytest.mark.parametrize("coarse", [COARSE, GridSpec(10.3, 0.1, 49.9, -0.07, 30, 40), GridSpec(10.0, 0.5, 50.0, -0.4, 5, 7)], ids=["larger", "smaller", "dividing"])
def test_any_factor(spark, coarse):
    rows, df = cells(spark)
    got = {(r.row, r.col): (r.mean, r.total) for r in regridded(df, [], ["v"], FINE, coarse).withColumnRenamed("v", "mean").join(regridded(df, [], ["v"], FINE, coarse, "sum").withColumnRenamed("v", "total"), ["row", "col"]).collect()}
    expected = {}
    for r, c in itertools.product(range(coarse.rows), range(coarse.cols)):
        parts = [(shared(a, r, FINE, coarse, 0) * shared(b, c, FINE, coarse, 1), v) for a, b, v, _ in rows]
        parts = [(w, v) for w, v in parts if w > 1e-9]
        if parts:
            area, total = sum(w for w, v in parts if v is not None), sum(w * v for w, v in parts if v is not None)
            expected[r, c] = (total / area if area else None, total)
    assert set(got) == set(expected)
    for k, (mean, total) in expected.items():
        assert (mean is None and got[k][0] is None) or math.isclose(got[k][0], mean, abs_tol=1e-9)
        assert math.isclose(got[k][1], total, abs_tol=1e-9)


def test_totals_are_kept(spark):
    rows, df = cells(spark)
    assert math.isclose(regridded(df, [], ["v"], FINE, COARSE, "sum").agg(F.sum("v")).first()[0], sum(v or 0 for *_, v, _ in rows), rel_tol=1e-12)
    assert math.isclose(overlaps(df, FINE, COARSE).agg(F.sum("share")).first()[0], len(rows), rel_tol=1e-12)


def test_integer_factors_equal_blocks(spark):
    _, df = cells(spark)
    whole = GridSpec(0, 1, 0, 1, 9, 13)
    blocks = {(r.row, r.col): r.v for r in coarsened(df, [], ["v"], 3, 4, 9, 13).collect()}
    got = {(r.row, r.col): r.v for r in regridded(df, [], ["v"], whole, GridSpec(0, 4, 0, 3, 3, 4)).collect()}
    assert set(blocks) < set(got) and all(math.isclose(got[k], v, rel_tol=1e-12) for k, v in blocks.items())


def test_class_areas_and_weights(spark):
    rows, df = cells(spark)
    got = {(r.row, r.col): r for r in class_areas(df, [1, 2], FINE, COARSE).collect()}
    areas = defaultdict(Counter)
    for (a, b, _, cls), r, c in itertools.product(rows, range(COARSE.rows), range(COARSE.cols)):
        w = shared(a, r, FINE, COARSE, 0) * shared(b, c, FINE, COARSE, 1)
        if w > 1e-9:
            areas[r, c][cls] += w
    assert set(got) == set(areas)
    for k, of in areas.items():
        assert math.isclose(got[k].wanted, of[1] + of[2], abs_tol=1e-6) and math.isclose(got[k].total, sum(of.values()), abs_tol=1e-6)
        assert of[got[k].dominant] >= max(of.values()) - 1e-6
    kept = area_weights(df.withColumn("keep", F.lit(1)), "keep", FINE, COARSE, 2.0).collect()
    assert all(r.n > 2 and math.isclose(r.weights, r.n / (0.62 * 0.55 / 0.05), rel_tol=1e-9) and r.weights <= 1 + 1e-9 for r in kept) and kept
