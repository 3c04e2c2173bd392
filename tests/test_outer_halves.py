"""Quantiles and median of the outer rows from one count of values."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdancy.operators.trends import dependence_fit
from verdancy.plans.panels import dependence_grid


@pytest.fixture(scope="module")
def rows(spark):
    x = F.when(F.col("id") % 17 > 0, F.pmod(F.xxhash64("id"), F.lit(40)) / 4)
    c = [F.when(F.col("id") % (5 + k) > 0, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100)) / 7).alias(f"c{k}") for k in range(3)]
    return spark.range(600).select((F.col("id") % 2).alias("g"), x.alias("d0"), (F.col("id") * F.lit(0.5)).alias("d1"), *c)


def test_grid_equals_single_fits_in_few_passes(spark, rows):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = dependence_grid(rows.mapInArrow(counted, rows.schema), ["g"], ["d0", "d1"], ["c0", "c1", "c2"], 3).collect()
    assert read.value <= 3 * 600
    key = lambda r: (r.g, r.half, r.k, round(r.x, 9), round(r.fit, 9))
    for d in ("d0", "d1"):
        for c in ("c0", "c1", "c2"):
            data = [(r.g, r[d], r[c]) for r in rows.collect() if r[d] is not None and r[c] is not None]
            low = Counter()
            for g in (0, 1):
                own = sorted(x for h, x, _ in data if h == g)
                at = lambda v, q: v[int(q * (len(v) - 1))] + (v[min(int(q * (len(v) - 1)) + 1, len(v) - 1)] - v[int(q * (len(v) - 1))]) * (q * (len(v) - 1) % 1)
                lo, hi = at(own, 0.25), at(own, 0.75)
                outer = [x for x in own if x <= lo or x >= hi]
                m = at(outer, 0.5)
                low[g, "low"], low[g, "high"] = max(x for x in outer if x < m), max(outer)
            some = [r for r in got if (r.driver, r.season) == (d, c)]
            assert {(r.g, r.half): r.x for r in some if r.k == 2} == pytest.approx(dict(low))
            alone = dependence_fit(rows, ["g"], d, c, 3).collect()
            assert sorted(map(key, some)) == sorted(map(key, alone))
