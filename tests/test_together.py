"""Forests grown together against a plain tree grower; contributions against predictions and exact subsets."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdancy.operators import together
from verdancy.operators.forest import cross_validated, window_models
from verdancy.operators.together import blocks, contributions_of, draws, forests, leaves

NAMES = ["a", "b", "c"]
DEPTH, TREES, FOLDS = 4, 4, 3


def table(spark, n=400):
    x = [F.round(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 50, 1).alias(c) for k, c in enumerate(NAMES)]
    df = spark.range(n).select("id", (F.col("id") % 2).alias("_group"), *x, (F.col("id") % 4 / 4 + 0.25).alias("w"))
    y = F.round(F.when(F.col("a") > 9, F.col("b")).otherwise(F.col("c") * F.col("c") / 10), 2).alias("y")
    df = df.select("*", y, F.col("id").alias("_row"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("_fold"))
    return df


def plain_tree(x, y, w, edges, depth):
    """value, feature and threshold of every node of a tree by a search over all cuts, node by node."""
    found = {}

    def grow(node, use):
        found[node] = (float(np.average(y[use], weights=w[use])), -1, math.nan, float(w[use].sum()))
        if node >= 2**depth - 1:
            return
        least, cuts = 1e-9 * (1 + (w[use] @ y[use]) ** 2 / w[use].sum()), []
        for f, e in enumerate(edges):
            for t in e:
                left, right = use & (x[:, f] <= t), use & (x[:, f] > t)
                if w[left].sum() > 0 and w[right].sum() > 0:
                    cuts.append((sum((w[s] @ y[s]) ** 2 / w[s].sum() for s in (left, right)) - (w[use] @ y[use]) ** 2 / w[use].sum(), f, t))
        top = max(cuts, default=(0,))[0]
        if top > least:
            _, f, t = next(cut for cut in cuts if cut[0] >= top - least)
            found[node] = (found[node][0], f, t, found[node][3])
            grow(2 * node + 1, use & (x[:, f] <= t))
            grow(2 * node + 2, use & (x[:, f] > t))

    grow(0, w > 0)
    return found


def as_dict(models):
    return {(r._group, r._fold, r._tree): r for r in models.collect()}


@pytest.fixture(scope="module")
def grown(spark):
    rows = table(spark)
    one = blocks(rows, NAMES, "y", "w", ["id"]).cache()
    many = blocks(rows, NAMES, "y", "w", ["id"], block_rows=30).cache()
    return rows, one, as_dict(forests(one, FOLDS, TREES, DEPTH, 7)), as_dict(forests(many, FOLDS, TREES, DEPTH, 7)), many


def test_trees_equal_a_plain_grower(grown):
    _, one, models, _, _ = grown
    assert len(models) == 2 * FOLDS * TREES
    for block in one.collect():
        y, w, h, fold = (np.frombuffer(block[c], together._PACKED[c]) for c in ("y", "w", "h", "fold"))
        x, edges = np.frombuffer(block.x).reshape(len(y), 3), np.frombuffer(block.edges).reshape(3, -1)
        for k, t in itertools.product(range(FOLDS), range(TREES)):
            use = fold != k
            drawn = w[use] * draws(h[use], k, t, 7)
            expected, got = plain_tree(x[use], y[use], drawn, edges, DEPTH), models[block._group, k, t]
            assert {i for i, c in enumerate(got.cover) if c > 0} == set(expected)
            for i, (value, f, threshold, cover) in expected.items():
                assert math.isclose(got.value[i], value, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got.cover[i], cover, rel_tol=1e-9)
                # equal gains of different cuts part the same rows
                assert got.feature[i] == f and (f < 0 or got.threshold[i] == threshold)


def test_groups_of_many_blocks_have_the_same_trees(grown):
    _, one, models, by_levels, many = grown
    assert many.count() > 10 and set(models) == set(by_levels)
    for key, t in models.items():
        other = by_levels[key]
        assert t.feature == other.feature and np.allclose(t.value, other.value, atol=1e-9) and np.array_equal(t.threshold, other.threshold, equal_nan=True)


def test_contributions_add_up_and_equal_subsets(grown, spark):
    rows, one, models, _, _ = grown
    table_of = spark.createDataFrame(list(models.values()), together.TREE)
    got = {r._row: r for r in contributions_of(one, table_of, NAMES, FOLDS, TREES).collect()}
    data = rows.collect()
    assert len(got) == len(data)

    def value(tree, x, known, i=0):
        """Expected value of a tree when only some features are known."""
        if tree.feature[i] < 0:
            return tree.value[i]
        f = tree.feature[i]
        if f in known:
            return value(tree, x, known, 2 * i + 1 if x[f] <= tree.threshold[i] else 2 * i + 2)
        return sum(tree.cover[j] / tree.cover[i] * value(tree, x, known, j) for j in (2 * i + 1, 2 * i + 2))

    for r in data[:40]:
        x, forest = [r[c] for c in NAMES], [models[r._group, r._fold, t] for t in range(TREES)]
        v = {s: sum(value(t, x, s) for t in forest) / TREES for n in range(4) for s in itertools.combinations(range(3), n)}
        assert math.isclose(got[r._row].base + sum(got[r._row].phi), v[0, 1, 2], abs_tol=1e-9) and math.isclose(got[r._row].base, v[()], abs_tol=1e-9)
        for f in range(3):
            rest = [k for k in range(3) if k != f]
            phi = sum(math.factorial(n) * math.factorial(2 - n) / 6 * (v[tuple(sorted((*s, f)))] - v[s]) for n in range(3) for s in itertools.combinations(rest, n))
            assert math.isclose(got[r._row].phi[f], phi, abs_tol=1e-9)


def test_leaves_part_the_space(grown):
    tree = next(iter(grown[2].values()))
    found = leaves(np.array(tree.feature), np.array(tree.threshold), np.array(tree.cover), np.array(tree.value), 3)
    x = np.random.default_rng(1).uniform(-1, 21, (500, 1, 3))
    assert (((x > found["low"]) & (x <= found["high"])).all(2).sum(1) == 1).all() and math.isclose(found["kept"].prod(1).sum(), 1)


def test_windows_and_folds_in_one_call(spark, monkeypatch):
    rows = table(spark, 500).select("id", *NAMES, "y", "w").crossJoin(spark.range(2001, 2006).withColumnRenamed("id", "year"))
    rows = rows.withColumn("y", F.col("y") + F.col("year") - 2000)
    got = window_models(rows, ["id"], NAMES, "y", "year", 2001, 2005, 3, "w", trees=8, depth=5, folds=4).collect()
    assert len(got) == 1500 and {r.window_start for r in got} == {2001, 2002, 2003}
    errors = defaultdict(list)
    for r in got:
        assert math.isclose(r.base + sum(r[f"phi_{c}"] for c in NAMES), r.prediction, abs_tol=1e-9)
        errors[r.window_start].append((r.prediction - r.y, r.y))
    for pairs in errors.values():
        e, y = np.array(pairs).T
        assert 1 - e @ e / ((y - y.mean()) @ (y - y.mean())) > 0.8


def test_small_and_empty_groups(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 2.0, 1.0), (2, 0, 2.0, 3.0, 1.0), (3, 0, None, 3.0, 1.0), (4, 7, 1.0, 9.0, 1.0), (5, 0, 3.0, 4.0, 0.0)], "id int, g int, a double, y double, w double")
    got = {r.id: r for r in cross_validated(rows.withColumn("f", F.col("id") % 2), ["id"], ["a"], "y", "w", fold="f", group="g", trees=3, depth=2).collect()}
    assert set(got) == {1, 2, 4, 5} and got[4].prediction is None and got[1].prediction == 3.0 and got[2].prediction == 2.0
    with pytest.raises(ValueError, match="rows of 0 folds"):
        cross_validated(rows.limit(0), ["id"], ["a"], "y", trees=2, depth=2)


def test_blocks_are_copied_for_neither_folds_nor_trees(grown, spark, monkeypatch, tmp_path):
    """A block meets all trees of its group at once; where these are large, in several parts with the same result."""
    rows, one, models, by_levels, many = grown
    plain = together._block

    def counted(batch, k):
        with open(log, "a") as f:
            f.write("x")
        return plain(batch, k)

    monkeypatch.setattr(together, "_block", counted)
    table_of = spark.createDataFrame(list(models.values()), together.TREE)
    n = many.count()

    def met(job, name):
        nonlocal log
        log = str(tmp_path / name)
        found = job().collect()
        return found, len(open(log).read())

    log = ""
    phi, read = met(lambda: contributions_of(many, table_of, NAMES, FOLDS, TREES), "phi")
    assert read == n
    assert met(lambda: forests(many, FOLDS, TREES, DEPTH, 7), "levels")[1] == DEPTH * n
    assert met(lambda: forests(one, FOLDS, TREES, DEPTH, 7), "alone")[1] <= together.SHARES * one.count()
    monkeypatch.setattr(together, "TREE_BYTES", 3 * 28 * FOLDS * 2**DEPTH)
    parted, read = met(lambda: contributions_of(many, table_of, NAMES, FOLDS, TREES), "parted")
    assert n < read <= TREES * n
    got = {r._row: (*r.phi, r.base) for r in parted}
    assert all(np.allclose(got[r._row], (*r.phi, r.base), atol=1e-9) for r in phi) and len(got) == len(phi)
    trees, read = met(lambda: forests(many, FOLDS, TREES, DEPTH, 7), "trees")
    assert read > DEPTH * n and {(t._group, t._fold, t._tree): t.feature for t in trees} == {key: t.feature for key, t in by_levels.items()}
