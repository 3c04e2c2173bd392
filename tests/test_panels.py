"""Panels over seasons against plain numpy."""

import numpy as np
import pytest

from verdancy.plans.panels import dependence_grid, season_classes, season_histograms, trend_anomaly_panels


def test_natural_classes_of_all_seasons(spark):
    rows = [(s, float(v)) for s in ("spring", "winter") for base in (0, 100, 1000) for v in (base, base + 1, base + 2)] + [("winter", None)]
    got = {(r["season"], r["class"]): (r["n"], r["low"], r["high"]) for r in season_classes(spark.createDataFrame(rows, "season string, v double"), "season", "v", 3).collect()}
    assert got == {(s, k): (3, b, b + 2) for s in ("spring", "winter") for k, b in enumerate((0.0, 100.0, 1000.0))}


def test_histograms_are_densities(spark):
    rows = [("a", x) for x in (0.0, 0.1, 0.9, 1.0)] + [("b", 0.5), ("b", 7.0), ("b", None)]
    got = {(r["season"], r["bin"]): (r["n"], r["density"]) for r in season_histograms(spark.createDataFrame(rows, "season string, v double"), "season", "v", 0.0, 1.0, 4).collect()}
    assert got == {("a", 0): (2, 2.0), ("a", 3): (2, 2.0), ("b", 2): (1, 4.0)}


def test_panels_equal_plain_fits(spark):
    rng = np.random.default_rng(5)
    years, cells, seasons = range(2001, 2008), range(4), ["spring", "winter"]
    contrib = [(y, float(a), float(b)) for y in years for a, b in rng.normal(size=(5, 2))]
    climate = [(c, s, y, float(rng.normal(c, 1))) for c in cells for s in seasons for y in years]
    got = trend_anomaly_panels(
        spark.createDataFrame(contrib, "window_start int, spring double, winter double"), spark.createDataFrame(climate, "cell int, season string, year int, tm double"), ["cell"], seasons, ["tm"], 2001, 2007
    ).collect()
    got = {(r["season"], r["panel"]): r["slope"] for r in got}
    for i, s in enumerate(seasons):
        share = {y: np.mean([abs(r[1 + i]) / (abs(r[1]) + abs(r[2])) for r in contrib if r[0] == y]) for y in years}
        value = {(c, y): v for c, t, y, v in climate if t == s}
        base = np.array([np.mean([value[c, y] for y in years]) for c in cells])
        z = {y: np.mean([np.mean([value[c, y + k] for k in range(3)]) for c in cells] - base) / base.std(ddof=1) for y in range(2001, 2006)}
        assert got[s, "trend"] == pytest.approx(np.polyfit(list(years), [share[y] for y in years], 1)[0])
        assert got[s, "tm"] == pytest.approx(np.polyfit([z[y] for y in z], [share[y] for y in z], 1)[0])


def test_dependence_grid_fits_every_pair(spark):
    rows = [("x", float(t), float((t * 7) % 40), 2.0 * t, -1.0 * t) for t in range(40)]
    got = dependence_grid(spark.createDataFrame(rows, "scenario string, tm double, vpd double, spring double, winter double"), ["scenario"], ["tm", "vpd"], ["spring", "winter"], 5).collect()
    assert len(got) == 2 * 2 * 2 * 5
    slopes = {(r["season"], r["half"]): r["slope"] for r in got if r["driver"] == "tm"}
    assert slopes == {(s, h): pytest.approx(v) for s, v in (("spring", 2.0), ("winter", -1.0)) for h in ("low", "high")}
