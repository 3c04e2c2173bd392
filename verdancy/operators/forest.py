"""Weighted random forests with cross-validation, and exact contributions of each feature to each prediction."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.functions.scalars import min_max
from verdancy.operators.aggregates import regression_metrics
from verdancy.operators.calendar import pooled_window, sliding_windows
from verdancy.operators.cleaning import complete_cases
from verdancy.operators.reshape import hash_fold, hashed_sample
from verdancy.operators.together import BLOCKS_IN_FILE, blocks, contributions_of, forests
from verdancy.session import shared_folder, written

TREES, FOLDS, SEED = 500, 10, 42
LEAF_BYTES = 1 << 30  # bound of a leaf table, which is broadcast
LEAVES_AT_ONCE, ROWS_AT_ONCE = 64, 2_000


def fit_forest(df: DataFrame, features: list[str], target: str, weight: str | None = None, trees: int = TREES, depth: int = 10, seed: int = SEED) -> RandomForestRegressionModel:
    """A forest over all features at each split; rows are weighted by their cell's support."""
    forest = RandomForestRegressor(featuresCol="_features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all", maxMemoryInMB=512)
    if weight:
        forest = forest.setWeightCol(weight)
    return forest.fit(VectorAssembler(inputCols=features, outputCol="_features").transform(df))


def leaf_table(model: RandomForestRegressionModel, features: int) -> dict[str, np.ndarray]:
    """Every leaf of a forest as a row: value, tree, and for each feature the interval (low, high] that leads there and the share of cover kept along it. Its size is the model's, not the data's, and checked against LEAF_BYTES. Reads the layout of saved forests of Spark 4.1."""
    spark = SparkSession.builder.getOrCreate()
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    size = (model.totalNumNodes + model.getNumTrees) // 2 * (3 * features + 2) * 8
    if size > LEAF_BYTES:
        raise ValueError(f"the leaves of this forest take {size} bytes, more than {LEAF_BYTES}: fit fewer or shallower trees")
    if "nodeData" not in nodes.columns:
        raise ValueError(f"unknown layout of a saved forest: {nodes.columns}")
    rows = nodes.select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        F.get("nodeData.impurityStats", F.lit(0)).alias("cover"), F.col("nodeData.split.featureIndex").alias("f"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("t"),
    ).toPandas()
    value, tree, low, high, kept = [], [], [], [], []
    for name, own in rows.groupby("treeID"):
        node = {r.id: r for r in own.itertuples()}
        stack = [(0, np.full(features, -np.inf), np.full(features, np.inf), np.ones(features))]
        while stack:
            at, lo, hi, r = stack.pop()
            n = node[at]
            if n.leftChild < 0:
                value.append(n.prediction), tree.append(name), low.append(lo), high.append(hi), kept.append(r)
                continue
            for child, left in ((n.leftChild, True), (n.rightChild, False)):
                lo2, hi2, r2 = lo.copy(), hi.copy(), r.copy()
                if left:
                    hi2[n.f] = min(hi[n.f], n.t)
                else:
                    lo2[n.f] = max(lo[n.f], n.t)
                r2[n.f] *= node[child].cover / n.cover if n.cover else 0.0
                stack.append((child, lo2, hi2, r2))
    return {"value": np.array(value), "tree": np.array(tree), "low": np.array(low), "high": np.array(high), "kept": np.array(kept)}


def leaf_contributions(x: np.ndarray, leaves: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
    """Path-dependent Shapley values of each row and feature, as a sum over leaves; and the base value.

    The weights of the subsets of the other features are integrals of u^k (1 - u)^(m - 1 - k), so their sum is the
    integral over u of a product over features: with z for whether the row is in the leaf's interval and r for the share
    of cover kept, of z u + r (1 - u). It is a polynomial, for which a Gauss rule of half as many nodes is exact.
    """
    trees = len(np.unique(leaves["tree"]))
    n, p = x.shape
    base = float((leaves["value"] * leaves["kept"].prod(1)).sum() / trees)
    nodes, weights = np.polynomial.legendre.leggauss(max(1, -(-p // 2)))
    phi = np.zeros((n, p))
    for top in range(0, n, ROWS_AT_ONCE):
        rows = x[top : top + ROWS_AT_ONCE, None]
        for at in range(0, len(leaves["value"]), LEAVES_AT_ONCE):
            low, high, r, value = (leaves[k][at : at + LEAVES_AT_ONCE] for k in ("low", "high", "kept", "value"))
            z = ((rows > low) & (rows <= high)).astype(float)
            total = np.zeros_like(z)
            for u, w in zip((nodes + 1) / 2, weights / 2, strict=True):
                f = z * u + r * (1 - u)  # never 0: every share is above 0 and u below 1
                total += w * f.prod(2)[:, :, None] / f
            phi[top : top + ROWS_AT_ONCE] += np.einsum("nlp,l->np", (z - r) * total, value)
    return phi / trees, base


def contributions(df: DataFrame, model: RandomForestRegressionModel, features: list[str]) -> DataFrame:
    """df with phi_<feature> of each row, base and prediction: the phi and the base add up to the prediction."""
    leaves = df.sparkSession.sparkContext.broadcast(leaf_table(model, len(features)))
    names = [f"phi_{f}" for f in features]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + ", ".join(f"`{c}` double" for c in [*names, "base", "prediction"])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            phi, base = leaf_contributions(pdf[features].to_numpy(float), leaves.value)
            yield pdf.assign(**{c: phi[:, k] for k, c in enumerate(names)}, base=base, prediction=phi.sum(1) + base)

    return df.mapInPandas(explain, schema)


def with_ratios(df: DataFrame, features: list[str]) -> DataFrame:
    """Signed share of each feature in the row's sum of absolute contributions."""
    total = reduce(lambda a, b: a + b, (F.abs(F.col(f"phi_{f}")) for f in features))
    return df.withColumns({f"ratio_{f}": F.try_divide(F.col(f"phi_{f}"), total) for f in features})


def cross_validated(df: DataFrame, keys: list[str], features: list[str], target: str, weight: str | None = None, folds: int = FOLDS, fold=None, group: str | None = None, trees: int = TREES, depth: int = 10, seed: int = SEED) -> DataFrame:
    """Out-of-fold contributions and predictions of every row: each fold is explained by a forest that never saw it.

    With `group`, an integer column, each of its values has forests of its own. The forests of all groups and folds are
    grown together and kept as a table of trees. `fold` may name a column of few values, each of which is left out once.
    Rows of a group whose other folds are empty have no contributions.
    """
    columns = [*dict.fromkeys([*keys, *features, target, *([weight] if weight else []), *([group] if group else [])])]
    if isinstance(fold, str) and fold not in columns:
        columns.append(fold)
    rows = complete_cases(df.select(*columns))
    rows = written(rows.withColumn("fold", F.col(fold) if isinstance(fold, str) else hash_fold(keys, folds)).withColumn("_row", F.monotonically_increasing_id()))
    found = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    if len(found) < 2:
        raise ValueError(f"rows of {len(found)} folds: no fold can be explained by a forest of the others")
    placed = rows.withColumn("_fold", F.array_position(F.array(*map(F.lit, found)), F.col("fold")).cast("int") - 1).withColumn("_group", F.col(group).cast("long") if group else F.lit(0).cast("long"))
    of = written(blocks(placed, features, target, weight, keys), BLOCKS_IN_FILE)
    models = written(forests(of, len(found), trees, depth, seed))
    told = contributions_of(of, models, features, len(found), trees)
    prediction = F.aggregate("_phi", F.col("base"), lambda a, x: a + x)
    joined = rows.join(told.withColumnRenamed("phi", "_phi"), "_row", "left").drop("_row")
    joined = joined.withColumns({f"phi_{f}": F.get("_phi", F.lit(k)) for k, f in enumerate(features)}).withColumn("prediction", prediction).drop("_phi")
    return with_ratios(joined.select(*columns, "fold", *(f"phi_{f}" for f in features), "base", "prediction"), features)


def fold_metrics(predictions: DataFrame, target: str) -> DataFrame:
    """Mean over folds of R2, squared and absolute error."""
    return regression_metrics(predictions, ["fold"], target, "prediction").agg(F.avg("r2").alias("r2"), F.avg("mse").alias("mse"), F.avg("mae").alias("mae"))


def window_models(df: DataFrame, keys: list[str], features: list[str], target: str, year: str, first: int, last: int, length: int = 3, weight: str | None = None, **cv) -> DataFrame:
    """Cross-validated models of every sliding window of years, grown together."""
    values = [*features, target, *([weight] if weight else [])]
    windows = sliding_windows(df, keys, year, values, first, last, length)
    return cross_validated(windows, keys, features, target, weight, group="window_start", **cv)


def pooled_models(df: DataFrame, keys: list[str], features: list[str], target: str, year: str, first: int, last: int, length: int = 3, weight: str | None = None, **cv) -> DataFrame:
    """Cross-validated models of every tumbling group of years, grown together, the rows of a group pooled; the last year is left out."""
    rows = df.where((F.col(year) >= first) & (F.col(year) < last)).withColumn("window", pooled_window(F.col(year), first, last, length))
    return cross_validated(rows, [*keys, year], features, target, weight, group="window", **cv)


def stacked_model(df: DataFrame, keys: list[str], features: list[str], target: str, n: int = 10_000, **cv) -> DataFrame:
    """Cross-validated model of cell-years on a sample of n rows."""
    return cross_validated(hashed_sample(df, keys, n), keys, features, target, **cv)


def holdout_model(df: DataFrame, keys: list[str], features: list[str], target: str, weight: str | None = None, share: int = 20, **forest) -> DataFrame:
    """Predictions of the `share` per cent of rows that a forest of the others never saw."""
    rows = complete_cases(df.select(*dict.fromkeys([*keys, *features, target, *([weight] if weight else [])])))
    test = F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(100)) < share
    model = fit_forest(rows.where(~test), features, target, weight, **forest)
    assembled = VectorAssembler(inputCols=features, outputCol="_features").transform(rows.where(test))
    return model.transform(assembled).drop("_features")


def normalised_weights(df: DataFrame, weight: str) -> DataFrame:
    ends = df.agg(F.min(weight).alias("_lo"), F.max(weight).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(weight, min_max(weight, "_lo", "_hi")).drop("_lo", "_hi")


def leave_one_out(df: DataFrame, group: str, keys: list[str], features: list[str], target: str, trees: int = 300, **cv) -> DataFrame:
    """Contributions in each group under a forest of all other groups."""
    return cross_validated(df, keys, features, target, fold=group, trees=trees, **cv)


def leave_one_out_r2(df: DataFrame, group: str, keys: list[str], features: list[str], target: str, trees: int = 300, **cv) -> DataFrame:
    return regression_metrics(leave_one_out(df, group, keys, features, target, trees, **cv), [group] if group in keys else ["fold"], target, "prediction")
