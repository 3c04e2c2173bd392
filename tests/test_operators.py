"""Hand-computed cases and properties of the library's operators."""

import datetime as dt
import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdancy.functions.scalars import absolute_share, drought_phase, region_number, row_mean, scaled, signed_share
from verdancy.functions.statistics import t_quantile
from verdancy.operators.aggregates import chilling_days, degree_days, natural_breaks, regression_metrics, slice_means, whisker_summary
from verdancy.operators.calendar import pooled_window, seasonal_means, sliding_windows
from verdancy.operators.cleaning import complete_cases, complete_stations, median_split, outer_quantiles, quantiles
from verdancy.operators.forest import contributions, cross_validated, fit_forest, leaf_contributions
from verdancy.operators.grid import class_share, coarsened, forest_mask, mosaic, nearest_index, nearest_valid, support
from verdancy.operators.reshape import grouped_sample, hashed_sample, wide_to_long, zero_crossings
from verdancy.operators.trends import _log_gamma, _normal_quantile, spei, theil_sen, theil_sen_band, trend
from verdancy.schema import nan_to_null


def one(df):
    return df.collect()[0][0]


def row(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_scaled_fill(spark):
    df = spark.createDataFrame([(5000,), (-3000,)], "raw int").select(scaled("raw"))
    assert [r[0] for r in df.collect()] == [0.5, None]


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(1.0, float("nan")), (3.0, 4.0)], "a double, b double"))
    assert tuple(df.agg(F.avg("a"), F.avg("b")).first()) == (2.0, 4.0)
    assert complete_cases(df).count() == 1


def test_slice_means_skip_flat_slices(spark):
    rows = [(2001, 1, "a", 1.0), (2001, 1, "b", 2.0), (2001, 2, "a", 7.0), (2001, 2, "b", 7.0), (2001, 3, "a", 3.0), (2001, 3, "b", 4.0), (2001, 4, "a", None), (2001, 4, "b", None)]
    got = slice_means(spark.createDataFrame(rows, "year int, slice int, cell string, v double"), ["cell"], "year", "slice", "v")
    assert {r.cell: r.v for r in got.collect()} == {"a": 2.0, "b": 3.0}


def test_winters(spark):
    days = [((2001, 1, 1), 2.0), ((2001, 2, 1), 4.0), ((2001, 12, 1), 6.0), ((2002, 1, 1), 100.0), ((2002, 2, 1), 2.0)]
    df = spark.createDataFrame([(1, dt.datetime(*d), v) for d, v in days], "cell int, ts timestamp, v double")
    got = {(r.season, r.season_year): r.v for r in seasonal_means(df, ["cell"], "ts", ["v"], ["winter", "winter_cross"]).collect()}
    assert got["winter", 2001] == 4.0 and got["winter_cross", 2001] == 36.0


def test_degree_and_chilling_days(spark):
    rows = [(1, 14.0), (1, 4.0), (2, 6.0), (2, 0.0), (3, None), (4, 4.9), (5, 5.0)]
    df = spark.createDataFrame([(k, dt.datetime(2001, 1, k), t) for k, t in rows], "k int, ts timestamp, t double")
    assert {r.k: r.gdd for r in degree_days(df, ["k"], "ts", "t").collect()} == {1: 4.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}
    assert {r.k: r.chilling for r in chilling_days(df, ["k"], "ts", "t").where("k > 2").collect()} == {3: None, 4: 1, 5: 0}


def test_mask_share_is_floored(spark):
    fine = spark.createDataFrame([(0, 0, 23), (0, 1, 23), (1, 0, 23), (1, 1, 1)], "lrow int, lcol int, cls int")
    shares = class_share(fine, spark.createDataFrame([(0, 0)], "row int, col int"), 1.5, [23, 25])
    for elevation, keep in ((800.0, 1), (801.0, 0)):
        elev = spark.createDataFrame([(0, 0, elevation)], "row int, col int, elev double")
        assert forest_mask(shares, elev).first().keep == keep


def test_coarsening_trims_and_conserves(spark):
    df = spark.createDataFrame([(r, c, float(r * 4 + c)) for r in range(5) for c in range(4)], "row int, col int, v double")
    got = coarsened(df, [], ["v"], 2, 2, 5, 4)
    assert got.count() == 4
    assert one(got.agg(F.avg("v"))) == one(df.where("row < 4").agg(F.avg("v")))


def test_support_needs_two(spark):
    df = spark.createDataFrame([(0, c, k) for c, k in ((0, 0), (1, 0), (2, 1), (3, 0), (4, 1), (5, 1))], "row int, col int, keep int")
    assert [(r.col, r.n, r.weights) for r in support(df, [], "keep", 1, 2, 1, 6).collect()] == [(2, 2, 1.0)]


def test_nearest_cell(spark):
    df = row(spark, a=0.26, b=-9.0, c=0.25, d=7.0).select(*(nearest_index(F.col(k), 0.0, 0.5, 3) for k in "abcd"))
    assert tuple(df.first()) == (1, 0, 1, 2)


def test_nearest_valid_region(spark):
    grid = spark.createDataFrame([(0, 0, 15), (0, 1, 4), (2, 0, 7), (9, 9, 15)], "row int, col int, id int")
    got = {(r.row, r.col): r.id for r in nearest_valid(grid, "id", 15, 3).collect()}
    assert got == {(0, 0): 4, (0, 1): 4, (2, 0): 7, (9, 9): None}


def test_windows(spark):
    df = spark.createDataFrame([(1, y, float(y)) for y in range(2001, 2006)], "cell int, year int, v double")
    got = {r.window_start: r.v for r in sliding_windows(df, ["cell"], "year", ["v"], 2001, 2005).collect()}
    assert got == {2001: 2002.0, 2002: 2003.0, 2003: 2004.0}
    identity = sliding_windows(df, ["cell"], "year", ["v"], 2001, 2005, 1)
    assert {r.window_start: r.v for r in identity.collect()} == {y: float(y) for y in range(2001, 2006)}
    years = spark.range(2001, 2011).withColumnRenamed("id", "year").groupBy(pooled_window(F.col("year"), 2001, 2011).alias("g")).count()
    assert {r.g: r["count"] for r in years.collect()} == {0: 3, 1: 3, 2: 4}


def test_zero_crossing(spark):
    df = spark.createDataFrame([(1, 2001, 1.0), (1, 2002, -3.0)], "k int, year int, y double")
    assert (2001.25, 0.0) in {(r.year, r.y) for r in zero_crossings(df, ["k"], "year", "y").collect()}


def test_shares(spark):
    df = spark.createDataFrame([(2.0, -1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    signed = [tuple(r) for r in df.select(*(signed_share(x, *"abcd") for x in "abcd")).collect()]
    assert signed == [(0.5, -0.25, 0.25, 0.0), (None,) * 4]
    assert tuple(df.select(*(absolute_share(x, *"abcd") for x in "abcd")).first()) == (0.5, 0.25, 0.25, 0.0)


def test_trend(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.5), ("a", 2, 2.0), ("b", 0, 1.0), ("b", 1, None), ("c", 0, 1.0), ("c", 1, 3.0)], "k string, x int, y double")
    got = {r.k: r for r in trend(df, ["k"], "x", "y").collect()}
    assert math.isclose(got["a"].slope, 0.5) and math.isclose(got["a"].intercept, 4 / 3) and math.isclose(got["a"].r2, 0.428571, abs_tol=1e-6)
    assert (got["b"].slope, got["b"].ci_low) == (None, None)
    assert (got["c"].slope, got["c"].ci_low, got["c"].ci_high) == (2.0, 2.0, 2.0)


def test_mosaic_first_valid(spark):
    tiles = spark.createDataFrame([(0, "A", 1, None), (1, "A", 1, 5.0), (0, "B", 2, 3.0), (1, "B", 2, 9.0), (2, "B", 2, None)], "cell int, tile string, nth int, v double")
    got = {r.cell: r.v for r in mosaic(tiles, ["cell"], "v", "nth").collect()}
    assert got == {0: 3.0, 1: 5.0, 2: None}


def test_station_completeness(spark):
    rows = [("two", y) for y in (2000, 2001, 2004, 2005)] + [("three", y) for y in (2000, 2001, 2005)]
    assert [r.s_id for r in complete_stations(spark.createDataFrame(rows, "s_id string, year int")).collect()] == ["two"]


def test_drought_phase(spark):
    df = spark.createDataFrame([(-0.5, 0.1, 0.0), (0.0, 0.1, 0.0), (-0.5, -0.1, 0.0), (None, 0.1, 0.0)], "spring double, summer double, autumn double")
    assert [r[0] for r in df.select(drought_phase("spring", "summer", "autumn")).collect()] == ["drought", "normal", None, None]


def test_region_numbers_and_row_means(spark):
    df = spark.createDataFrame([("R3",), ("3-Alpine",), ("none",), (None,)], "t string").select(region_number("t"))
    assert [r[0] for r in df.collect()] == [3, 3, 0, 0]
    assert tuple(row(spark, a=1.0, b=3.0).withColumn("c", F.lit(None).cast("double")).select(row_mean("a", "b", "c"), row_mean("c")).first()) == (2.0, None)


def test_splits_and_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 9)], "k string, v double")
    assert sorted(r.v for r in outer_quantiles(df, "v", ["k"]).collect()) == [1.0, 2.0, 7.0, 8.0]
    assert median_split(df, "v", ["k"]).where("half = 'low'").count() == 4
    odd = df.where("v < 8")
    assert median_split(odd, "v", ["k"], overlap=True).count() == 8


def test_ranked_quantiles_are_exact(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("v"))
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.981, "e": 1.0}
    exact = sorted(tuple(round(x, 9) for x in r) for r in quantiles(df, "v", ["k"], qs).collect())
    assert sorted(tuple(round(x, 9) for x in r) for r in quantiles(df.repartition(9), "v", ["k"], qs, ranked=True).collect()) == exact
    assert [round(x, 9) for x in quantiles(df, "v", [], qs, ranked=True).first()] == [round(x, 9) for x in quantiles(df, "v", [], qs).first()]


def test_thin_groups_have_narrow_whiskers(spark):
    got = whisker_summary(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, v double"), ["k"], "v", 10.0).first()
    assert (got.q05, got.q50, got.q95) == (1.9, 2.0, 2.1)


def test_wide_to_long_keeps_gaps(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 5.0)], "cell int, evi_2001 double, evi_2002 double, sif_2001 double")
    assert sorted(map(tuple, wide_to_long(df, ["cell"]).collect())) == [(1, 2001, 1.0, 5.0), (1, 2002, 2.0, None)]


def test_samples_are_stable(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 30, "small").otherwise("large"))
    a = {r.id for r in hashed_sample(df, ["id"], 100).collect()}
    assert len(a) == 100 and a == {r.id for r in hashed_sample(df.repartition(7), ["id"], 100).collect()}
    assert {r.g: r["count"] for r in grouped_sample(df, ["g"], ["id"]).groupBy("g").count().collect()} == {"small": 30, "large": int(4970 * 0.07)}


def test_metrics_against_numpy(spark):
    r = np.random.default_rng(0)
    y, p = r.standard_normal(50), r.standard_normal(50)
    got = regression_metrics(spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(y, p, strict=True)], "f int, y double, p double"), ["f"], "y", "p").first()
    assert math.isclose(got.r2, 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and math.isclose(got.mae, np.abs(y - p).mean())


def test_theil_sen_against_numpy(spark):
    r = np.random.default_rng(1)
    x, y = np.arange(12.0), r.standard_normal(12).cumsum()
    slopes = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(12) for j in range(i + 1, 12)]
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)], "k string, x double, y double")
    got = theil_sen(df, ["k"], "x", "y").first()
    assert math.isclose(got.slope, np.median(slopes)) and math.isclose(got.intercept, np.median(y - np.median(slopes) * x))
    band = theil_sen_band(df, ["k"], "x", "y", draws=100).first()
    assert band.low <= got.slope <= band.high


def test_t_quantiles():
    for df, t in ((1, 12.7062), (2, 4.30265), (5, 2.57058), (10, 2.22814), (30, 2.04227)):
        assert math.isclose(t_quantile(df), t, abs_tol=2e-4)


def test_spei_is_standardised(spark):
    r = np.random.default_rng(2)
    rows = [(1, 1951 + k // 12, k % 12 + 1, float(v)) for k, v in enumerate(r.gamma(2.0, 10.0, 70 * 12))]
    got = spei(spark.createDataFrame(rows, "cell int, year int, month int, water double"), ["cell"], "year", "month", "water").toPandas()
    assert got["spei"].isna().sum() == 2 and abs(got["spei"].mean()) < 0.1 and abs(got["spei"].std() - 1) < 0.1
    rolled = got.sort_values(["year", "month"])["water"].rolling(3).sum()
    january = got.sort_values(["year", "month"]).assign(rolled=rolled).query("month == 1").dropna()
    assert january["rolled"].rank().corr(january["spei"].rank()) > 0.999


def test_distributions_against_the_standard_library():
    p = np.r_[np.linspace(1e-6, 1 - 1e-6, 2001), 0.02425, 0.97575]
    assert np.allclose(_normal_quantile(p), [NormalDist().inv_cdf(v) for v in p], rtol=2e-9, atol=2e-9)
    x = np.r_[np.geomspace(1e-3, 500, 300)]
    assert np.allclose(_log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def subset_contributions(x, leaves):
    """Shapley values by their definition: over all subsets of the features."""
    n, p = x.shape
    phi = np.zeros((n, p))
    for value, lo, hi, r in zip(leaves["value"], leaves["low"], leaves["high"], leaves["kept"], strict=True):
        z = ((x > lo) & (x <= hi)).astype(float)
        for i in range(p):
            others = [j for j in range(p) if j != i]
            for size in range(p):
                for chosen in combinations(others, size):
                    rest = [j for j in others if j not in chosen]
                    w = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
                    phi[:, i] += value * w * (z[:, i] - r[i]) * z[:, list(chosen)].prod(1) * r[rest].prod()
    return phi / len(np.unique(leaves["tree"]))


@pytest.mark.parametrize("p", [1, 2, 5, 7])
def test_contributions_equal_the_subset_formula(p):
    r = np.random.default_rng(p)
    low = np.where(r.random((90, p)) < 0.5, -np.inf, r.normal(-1, 1, (90, p)))
    high = np.where(r.random((90, p)) < 0.5, np.inf, r.normal(1, 1, (90, p)))
    kept = np.where(np.isinf(low) & np.isinf(high), 1.0, r.uniform(0.01, 1, (90, p)))
    leaves = {"value": r.normal(0, 3, 90), "tree": np.arange(90) % 9, "low": low, "high": high, "kept": kept}
    x = r.standard_normal((40, p))
    assert np.allclose(leaf_contributions(x, leaves)[0], subset_contributions(x, leaves), atol=1e-12)


def test_contributions_of_a_large_forest(spark):
    """100 trees of depth 10 over seven features."""
    r = np.random.default_rng(6)
    x = r.standard_normal((1500, 7))
    names = list("abcdefg")
    y = x[:, 0] + x[:, 1] * x[:, 2] + 0.2 * r.standard_normal(1500)
    df = spark.createDataFrame([(k, *map(float, a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "id int, " + ", ".join(f"{c} double" for c in names) + ", y double")
    model = fit_forest(df, names, "y", trees=100, depth=10)
    from pyspark.ml.feature import VectorAssembler

    some = df.where("id < 200")
    truth = {r.id: r.prediction for r in model.transform(VectorAssembler(inputCols=names, outputCol="_features").transform(some)).collect()}
    got = contributions(some, model, names).collect()
    assert len(got) == 200 and all(math.isclose(r.base + sum(r[f"phi_{c}"] for c in names), truth[r.id], abs_tol=1e-9) for r in got)


def test_grouped_sample_equals_ranking(spark):
    df = spark.range(4000).withColumn("g", F.when(F.col("id") < 30, "small").when(F.col("id") < 330, "middle").otherwise("large"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("42"))), "id"))
    ranked = df.withColumn("rn", rank).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    expected = {r.id for r in ranked.where("rn <= least(n, greatest(50, floor(n * 0.07)))").collect()}
    assert {r.id for r in grouped_sample(df, ["g"], ["id"]).collect()} == expected and len(expected) == 30 + 50 + int(3670 * 0.07)


def test_natural_breaks_find_clusters(spark):
    rows = [(c + d / 100,) for c in (0.0, 10.0, 20.0, 50.0, 90.0) for d in range(20)]
    assert natural_breaks(spark.createDataFrame(rows, "v double"), "v", 5) == pytest.approx([0.19, 10.19, 20.19, 50.19, 90.19])
    assert natural_breaks(spark.createDataFrame([(None,)], "v double"), "v") == []


def test_contributions_add_up(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 3))
    y = x[:, 0] * 2 + np.sin(x[:, 1]) + 0.1 * r.standard_normal(400)
    df = spark.createDataFrame([(k, *map(float, a), float(b), float(1 + k % 3)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, y double, w double")
    model = fit_forest(df, ["a", "b", "c"], "y", "w", trees=8, depth=5)
    from pyspark.ml.feature import VectorAssembler

    truth = {r.id: r.prediction for r in model.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="_features").transform(df)).collect()}
    got = contributions(df, model, ["a", "b", "c"]).collect()
    assert all(math.isclose(r.base + r.phi_a + r.phi_b + r.phi_c, truth[r.id], abs_tol=1e-9) for r in got)
    assert sum(abs(r.phi_a) for r in got) > 5 * sum(abs(r.phi_c) for r in got)
    out = cross_validated(df, ["id"], ["a", "b", "c"], "y", "w", folds=3, trees=5, depth=4)
    assert out.count() == 400 and out.where("abs(abs(ratio_a) + abs(ratio_b) + abs(ratio_c) - 1) > 1e-9").count() == 0


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k % 7, k % 5 + 2000, float(k * k % 31)) for k in range(300)], "cell int, year int, v double")
    runs = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        runs.append(sorted(map(tuple, sliding_windows(df.repartition(n), ["cell"], "year", ["v"], 2000, 2004).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1]
