"""Forests and contributions over all rows, years and folds; forests are smaller than the operators' defaults, so that a query takes seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.operators.forest import cross_validated, fold_metrics, holdout_model, leave_one_out, leave_one_out_r2, normalised_weights, pooled_models, stacked_model, window_models
from verdancy.queries.frames import Queries, regional, yearly

QUERIES = Queries()
FEATURES = ["tp", "vpd", "tm"]
_SMALL = {"trees": 20, "depth": 6, "folds": 10}
_SMALLER = {"trees": 10, "depth": 6, "folds": 5}


def cells(spark, d):
    return yearly(spark, d).withColumn("weights", (F.col("col") % 5 + 1) / 5)


@QUERIES("i1_weighted_forest")
def i1(spark, d):
    return holdout_model(cells(spark, d), ["row", "col", "year"], FEATURES, "value", "weights", trees=10, depth=5)


@QUERIES("i2_cross_validation")
def i2(spark, d):
    out = cross_validated(cells(spark, d), ["row", "col", "year"], FEATURES, "value", "weights", **_SMALL)
    return out.select("row", "col", "year", "fold", F.col("value").alias("true_value"), F.col("prediction").alias("predicted_value"))


@QUERIES("i2_fold_metrics")
def i2_metrics(spark, d):
    return fold_metrics(cross_validated(cells(spark, d), ["row", "col", "year"], FEATURES, "value", "weights", **_SMALL), "value")


@QUERIES("i3_contributions")
def i3(spark, d):
    return cross_validated(cells(spark, d), ["row", "col", "year"], FEATURES, "value", "weights", **_SMALL)


@QUERIES("i4_window_models")
def i4(spark, d):
    y = yearly(spark, d)
    return window_models(y, ["row", "col"], FEATURES, "value", "year", 1995, 2001, 3, **_SMALLER)


@QUERIES("i5_pooled_models")
def i5(spark, d):
    return pooled_models(yearly(spark, d), ["row", "col"], FEATURES, "value", "year", 1995, 2001, 3, **_SMALLER)


@QUERIES("i6_stacked_model")
def i6(spark, d):
    return stacked_model(yearly(spark, d), ["row", "col", "year"], FEATURES, "value", 10_000, **_SMALL)


@QUERIES("i7_holdout_model")
def i7(spark, d):
    return holdout_model(yearly(spark, d), ["row", "col", "year"], FEATURES, "value", trees=5, depth=4)


@QUERIES("i8_normalised_weights")
def i8(spark, d):
    weighed = normalised_weights(cells(spark, d), "weights")
    return cross_validated(weighed, ["row", "col", "year"], FEATURES, "value", "weights", **_SMALLER)


@QUERIES("i9_leave_one_region_out")
def i9(spark, d):
    c = regional(spark, d).groupBy("row", "region").agg(*(F.avg(x).alias(x) for x in ("value", *FEATURES)))
    return leave_one_out(c, "region", ["row", "region"], FEATURES, "value", trees=20, depth=6)


@QUERIES("i10_leave_one_out_r2")
def i10(spark, d):
    c = regional(spark, d).groupBy("row", "region").agg(*(F.avg(x).alias(x) for x in ("value", *FEATURES)))
    return leave_one_out_r2(c, "region", ["row", "region"], FEATURES, "value", trees=20, depth=6)


@QUERIES("i11_contribution_summary")
def i11(spark, d):
    out = cross_validated(cells(spark, d), ["row", "col", "year"], FEATURES, "value", "weights", **_SMALLER)
    names = [*(f"phi_{f}" for f in FEATURES), *(f"ratio_{f}" for f in FEATURES)]
    return out.select("row", "col", "year", *FEATURES, F.col("value").alias("target"), *names)
