import math

import numpy as np
import pytest

from verdancy.llm import embeddings
from verdancy.llm.embeddings import band_plan, vector_links

VECTORS = "vec_id long, embedding array<double>, class long, component string, links long, vector string"


def brute(vectors, cosine):
    ids = list(vectors)
    ok = [i for i in ids if vectors[i] is not None and all(c is not None and math.isfinite(c) for c in vectors[i]) and any(vectors[i])]
    up, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ok:
        for b in ok:
            if a < b:
                x, y = np.array(vectors[a]), np.array(vectors[b])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[a] += 1
                    n[b] += 1
                    i, j = find(a), find(b)
                    up[max(i, j)] = min(i, j)
    return {i: (n[i], find(i)) for i in ids}


def data():
    r = np.random.default_rng(1)
    out = {}
    for k in range(60):
        base = r.standard_normal(16)
        for _ in range(3):
            out[len(out)] = (base + 0.1 * r.standard_normal(16)).tolist()
    hot = r.standard_normal(16)
    for _ in range(150):
        out[len(out)] = (hot + 0.15 * r.standard_normal(16)).tolist()
    for _ in range(40):
        out[len(out)] = hot.tolist()
    return out


@pytest.mark.parametrize("block", [1024, 32])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    vectors = data()
    special = {5000: None, 5001: [0.0] * 16, 5002: [None, *[1.0] * 15], 5003: [float("nan")] * 16, 5004: [float("inf"), *[1.0] * 15], 5005: [1.0] * 3, 5006: []}
    rows = [(i, x, 1, "c", 2, "v") for i, x in (vectors | special).items()] + [(None, [1.0] * 16, 1, "c", 2, "v"), (0, vectors[0], 1, "c", 2, "v")]
    got = vector_links(spark.createDataFrame(rows, VECTORS)).collect()
    found = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None}
    expected = brute(vectors, 0.9) | {i: (0, i) for i in special}
    assert found.keys() == expected.keys() and all(found[i] == (0, i) for i in special)
    assert sum(n for n, _ in found.values()) >= 0.97 * sum(n for n, _ in expected.values())
    assert all(found[i][0] <= expected[i][0] for i in expected)
    assert sum(found[i][1] == expected[i][1] for i in expected) >= 0.99 * len(expected)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]


def test_each_length_by_itself(spark):
    vectors = {1: [1.0, 0.0], 2: [1.0, 0.1], 3: [1.0, 0.0, 0.0], 4: [1.0, 0.1, 0.0], 5: [1.0, 0.0, 0.0], 6: [0.0, 1.0, 0.0], 7: [2.0]}
    got = vector_links(spark.createDataFrame([(i, x, 1, "c", 2, "v") for i, x in vectors.items()], VECTORS)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6), 7: (0, 7)}


@pytest.mark.parametrize("dim", [5, 64])
def test_estimates_from_short_codes_are_unbiased_within_their_bound(dim):
    r = np.random.default_rng(3)
    a = r.standard_normal((4000, dim))
    b = a + 0.4 * r.standard_normal((4000, dim))
    turn = embeddings._rotations(dim, 1)[0]
    x, y = ((v / np.linalg.norm(v, axis=1)[:, None]) @ turn for v in (a, b))
    short = embeddings._short(np.concatenate([x, y]), np.abs(np.concatenate([x, y])).sum(1) / math.sqrt(dim))
    signs, parts, factor, rounding = embeddings._read_short(short, dim)
    true = (x * y).sum(1)
    error = (signs[:4000] * parts[4000:]).sum(1) / factor[:4000] - true
    near = true >= 0.9
    assert abs(error.mean()) < 0.01
    assert (np.abs(error[near]) <= embeddings._slack(factor[:4000], rounding[4000:], dim, 0.9)[near]).mean() > 0.999


def test_bands_follow_the_table(spark):
    for rows in (10, 10_000, 10**9):
        bits, bands = band_plan(rows, 64, 0.9)
        assert (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** bands <= embeddings.MISS


def test_empty_and_unusable(spark):
    assert vector_links(spark.createDataFrame([], VECTORS)).collect() == []
    only = spark.createDataFrame([(1, None, 0, "", 0, ""), (2, [0.0], 0, "", 0, "")], VECTORS)
    assert sorted(map(tuple, vector_links(only).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_no_link_is_lost_just_above_the_threshold(spark):
    """Ten seeds of pairs at cosines of 0.900 to 0.905, each far from all others."""
    rows, expected = [], set()
    for seed in range(10):
        r = np.random.default_rng(seed)
        for k in range(120):
            a, b = r.standard_normal((2, 64))
            a /= np.linalg.norm(a)
            b -= (a @ b) * a
            b /= np.linalg.norm(b)
            c = r.uniform(0.9 + 1e-6, 0.905)
            i = 2 * (120 * seed + k)
            rows += [(i, (a * 3).tolist()), (i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
            expected.add(i)
    got = vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component_id for r in got} == expected and all(r.n_links == 1 for r in got)
