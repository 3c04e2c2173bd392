"""Whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.operators.calendar import seasonal_means
from verdancy.operators.grid import GridSpec, coarsened, support
from verdancy.plans.incremental import SeasonalSummary
from verdancy.plans.pipelines import add_factors, anomaly_maps, drought_legacy, maps_with_profiles, panel_limit, phenology_stack, pixel_summary, repair_winter, sensitivity_panel, study_area, summarize_cells, tag_regions, trend_anomaly_grid, union_countries, wide_summary
from verdancy.queries.frames import CONTRIBUTIONS, LANDCOVER, OBS, YEARLY, Queries, contributions, grid_size, landcover, obs, r6, r6_ties, scratch, yearly
from verdancy.queries.grids import _NEAREST
from verdancy.queries.summaries import _MASK, _SHARE, mask, season_sql, shares
from verdancy.queries.windows import WINDOW3, YEARS

QUERIES = Queries()
_SEASONS = ["spring", "winter"]
_CELLS = f"""{season_sql(_SEASONS)}, kept AS (SELECT * FROM obs SEMI JOIN (SELECT * FROM mask WHERE keep = 1) USING (row, col)),
 seas AS (SELECT row, col, season, (year + shift)::INT AS season_year, avg(value) AS value, avg(tp) AS tp FROM kept JOIN cal ON month * 100 + day(ts) BETWEEN a AND b GROUP BY ALL),
 sup AS (SELECT row // 4 AS row, col // 5 AS col, sum(keep) AS n FROM mask WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 4 * 4 FROM part) GROUP BY 1, 2),
 cells AS (SELECT (seas.row // 4)::INT AS row, (seas.col // 5)::INT AS col, season, season_year, avg(value) AS value, avg(tp) AS tp FROM seas WHERE seas.row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 4 * 4 FROM part) GROUP BY ALL),
 summ AS (SELECT c.*, n / 20 AS weights FROM cells c JOIN sup s ON c.row = s.row AND c.col = s.col WHERE n > 12)"""


def summary(spark, d):
    return summarize_cells(obs(spark, d), mask(spark, d), "ts", ["value", "tp"], _SEASONS, grid_size(spark, d), (4, 5), more_than=12)


@QUERIES("k1_summarize_cells", f"WITH {OBS}, {LANDCOVER}, {_MASK}, {_CELLS} SELECT row, col, season, season_year, round(value + 1e-10, 6) AS value, round(tp + 1e-10, 6) AS tp, round(weights, 6) AS weights FROM summ")
def k1(spark, d):
    return summary(spark, d).select("row", "col", "season", "season_year", r6_ties("value").alias("value"), r6_ties("tp").alias("tp"), r6("weights").alias("weights"))


_WIDE = ", ".join(f"round(max({v}) FILTER (season = '{s}' AND season_year = {y}) + 1e-10, 6) AS {v}_{s}_{y}" for v in ("value", "tp") for s in _SEASONS for y in YEARS)


@QUERIES("k1_wide_summary", f"WITH {OBS}, {LANDCOVER}, {_MASK}, {_CELLS} SELECT row, col, round(weights, 6) AS weights, {_WIDE} FROM summ GROUP BY row, col, weights")
def k1_wide(spark, d):
    wide = wide_summary(summary(spark, d), YEARS, _SEASONS, ["value", "tp"])
    return wide.select("row", "col", *((r6 if c == "weights" else r6_ties)(c).alias(c) for c in wide.columns if c not in ("row", "col")))


_FOUR = ["spring", "summer", "autumn", "winter_cross"]


@QUERIES("k1_batched_windows", f"WITH {OBS}, {season_sql(_FOUR)}, s AS (SELECT row, col, season, year + shift AS season_year, avg(value) AS value FROM obs JOIN cal ON month * 100 + day(ts) BETWEEN a AND b GROUP BY ALL) SELECT row, col, season, w AS window_start, round(avg(value), 6) AS value FROM s JOIN (SELECT unnest(range({YEARS[0]}, {YEARS[-1] - 1}))::INT AS w) ON season_year BETWEEN w AND w + 2 GROUP BY ALL")
def k1_batched(spark, d):
    """Years come as batches; after the first refresh only the windows of the last two years are written again, and a repeated batch is passed over."""
    o = obs(spark, d).select("row", "col", "ts", "year", "value")
    store = SeasonalSummary(spark, scratch(spark), ["row", "col"], ["value"], _FOUR)
    late = [str(y) for y in YEARS[-2:]]
    store.add("before", o.where(F.col("year") < YEARS[-2]), "ts")
    store.refresh(YEARS[0], YEARS[-1])
    for y in [*YEARS[-2:], YEARS[-1]]:
        store.add(str(y), o.where(F.col("year") == y), "ts")
    store.refresh(YEARS[0], YEARS[-1], batches=late)
    return store.windows().select("row", "col", "season", "window_start", r6("value").alias("value"))


@QUERIES("k2_add_factors", f"WITH {YEARLY}, {LANDCOVER}, f AS (SELECT row, col, avg(tm) AS tm FROM yearly GROUP BY 1, 2) SELECT l.row, l.col, elev, round(tm, 6) AS tm FROM landcover l LEFT JOIN f USING (row, col)")
def k2(spark, d):
    factors = yearly(spark, d).groupBy("row", "col").agg(r6(F.avg("tm")).alias("tm"))
    return add_factors(landcover(spark, d).select("row", "col", "elev"), factors)


@QUERIES("k3_repair_winter", f"WITH {YEARLY}, f AS (SELECT row, col, year, avg(tp) AS tp_winter FROM obs WHERE month IN (1, 2, 12) GROUP BY ALL) SELECT y.row, y.col, y.year, round(coalesce(f.tp_winter, y.tp), 6) AS tp_winter FROM yearly y LEFT JOIN f ON f.row = y.row AND f.col = y.col AND f.year = y.year")
def k3(spark, d):
    old = yearly(spark, d).select("row", "col", "year", F.col("tp").alias("tp_winter"))
    return repair_winter(old, obs(spark, d), ["row", "col", "year"], "ts", "tp", "tp_winter").withColumn("tp_winter", r6("tp_winter"))


_PIXEL = ", ".join(f"round(avg(value) FILTER (year = {y}), 6) AS value_{y}" for y in YEARS)


@QUERIES("k4_pixel_summary", f"WITH {OBS}, {LANDCOVER}, {_SHARE} SELECT s.row, s.col, s.dominant, {_PIXEL} FROM shares s JOIN obs ON obs.row = s.row AND obs.col = s.col GROUP BY ALL")
def k4(spark, d):
    seasonal = seasonal_means(obs(spark, d), ["row", "col"], "ts", ["value"], ["annual"]).withColumn("value", r6("value"))
    return pixel_summary(shares(spark, d), seasonal, YEARS, ["value"])


@QUERIES("k5_resummary", f"WITH {YEARLY}, {LANDCOVER}, {_MASK}, s AS (SELECT row // 8 AS row, col // 10 AS col, sum(keep) AS n FROM mask WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 8 * 8 FROM part) GROUP BY 1, 2), c AS (SELECT row // 8 AS row, col // 10 AS col, year, avg(value) AS value FROM yearly WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 8 * 8 FROM part) GROUP BY ALL) SELECT c.row::INT AS row, c.col::INT AS col, year, round(value, 6) AS value FROM c JOIN s ON s.row = c.row AND s.col = c.col WHERE n > 51")
def k5(spark, d):
    cells = coarsened(yearly(spark, d), ["year"], ["value"], 8, 10, *grid_size(spark, d))
    kept = support(mask(spark, d), [], "keep", 8, 10, *grid_size(spark, d), more_than=51)
    return cells.join(kept.select("row", "col"), ["row", "col"]).select("row", "col", "year", r6("value").alias("value"))


@QUERIES("k6_tag_regions", f"WITH {OBS}, {LANDCOVER}, {_NEAREST}, g AS (SELECT row, col, region_id FROM landcover WHERE region_id <> 15 UNION ALL SELECT l.row, l.col, nv.region_id FROM landcover l LEFT JOIN nv USING (row, col) WHERE l.region_id = 15) SELECT o.ord, o.line, o.part, g.region_id FROM obs o LEFT JOIN g ON g.row = o.row AND g.col = o.value::INT // 2 AND g.col < 25")
def k6(spark, d):
    points = obs(spark, d).select("ord", "line", "part", F.col("value").alias("x"), F.col("row").cast("double").alias("y"))
    return tag_regions(points, landcover(spark, d), GridSpec(0.0, 2.0, 0.0, 1.0, grid_size(spark, d)[0], 25), "x", "y").select("ord", "line", "part", "region_id")


@QUERIES("k7_union_countries", f"WITH {YEARLY} SELECT CASE WHEN col < 25 THEN 'west' ELSE 'east' END AS country, row, col, year, round(value, 6) AS value FROM yearly")
def k7(spark, d):
    y = yearly(spark, d).select("row", "col", "year", r6("value").alias("value"))
    return union_countries({"west": y.where("col < 25"), "east": y.where("col >= 25")})


@QUERIES("k8_anomaly_maps", f"WITH {YEARLY}, a AS (SELECT row, col, year, tp - avg(tp) OVER (PARTITION BY row, col) AS x FROM yearly) SELECT year, (row // 2)::INT AS row, (col // 5)::INT AS col, round(avg(x), 6) AS anomaly FROM a WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 2 * 2 FROM part) GROUP BY ALL")
def k8(spark, d):
    return anomaly_maps(yearly(spark, d), ["row", "col"], "tp", grid_size(spark, d), (2, 5)).withColumn("anomaly", r6("anomaly"))


_ROW = "SELECT '{w}' AS what, round(regr_slope(y, x), 8) AS slope FROM ({q})"


@QUERIES(
    "k9_trend_anomaly_grid",
    f"WITH {CONTRIBUTIONS}, yearly AS (SELECT row, col, year, avg(value) AS value, avg(tp) AS tp FROM obs GROUP BY ALL), {WINDOW3}, b AS (SELECT row, col, avg(value) AS bv, avg(tp) AS bt FROM yearly GROUP BY 1, 2) "
    + " UNION ALL ".join(
        _ROW.format(w=w, q=q)
        for w, q in (
            ("share", "SELECT year AS x, avg(abs(spring) / nullif(abs(spring) + abs(summer) + abs(autumn) + abs(winter), 0)) AS y FROM contrib GROUP BY year"),
            ("value", "SELECT window_start AS x, avg(value - bv) / stddev_samp(bv) AS y FROM w JOIN b USING (row, col) GROUP BY 1"),
            ("tp", "SELECT window_start AS x, avg(tp - bt) / stddev_samp(bt) AS y FROM w JOIN b USING (row, col) GROUP BY 1"),
        )
    ),
)
def k9(spark, d):
    c = contributions(spark, d).withColumn("window_start", F.col("year"))
    g = trend_anomaly_grid(c, yearly(spark, d), ["row", "col"], "spring", ["spring", "summer", "autumn", "winter"], ["value", "tp"], 1995, 2001)
    return g.select("what", F.round("slope", 8).alias("slope"))


_PANEL = "l AS (UNPIVOT (SELECT region, abs(spring) / t AS spring, abs(summer) / t AS summer, abs(autumn) / t AS autumn, abs(winter) / t AS winter FROM (SELECT *, nullif(abs(spring) + abs(summer) + abs(autumn) + abs(winter), 0) AS t FROM contrib)) ON spring, summer, autumn, winter INTO NAME season VALUE share), p AS (SELECT region, season, avg(share) AS mean, quantile_cont(share, 0.5) AS q50 FROM l GROUP BY 1, 2), o AS (SELECT season, avg(share) AS overall FROM l GROUP BY 1)"


def panel(spark, d):
    c = contributions(spark, d).select("region", *(F.col(s).alias(f"tp_{s}_shap_value") for s in ("spring", "summer", "autumn", "winter")))
    return sensitivity_panel(c, "region")


@QUERIES("k10_sensitivity_panel", f"WITH {CONTRIBUTIONS}, {_PANEL} SELECT region, season, round(mean, 6) AS mean, round(q50, 6) AS q50, round(mean - overall, 6) AS delta FROM p JOIN o USING (season)")
def k10(spark, d):
    return panel(spark, d).select("region", "season", r6("mean").alias("mean"), r6("q50").alias("q50"), r6("delta").alias("delta"))


@QUERIES("k10_panel_limit", f"WITH {CONTRIBUTIONS}, {_PANEL} SELECT round(least(0.5, greatest(0.25, quantile_cont(x, 0.5))), 6) AS lim FROM (SELECT region, quantile_cont(abs(mean - overall), 0.95) AS x FROM p JOIN o USING (season) GROUP BY region)")
def k10_limit(spark, d):
    return panel_limit(panel(spark, d), "region").select(r6("limit").alias("lim"))


@QUERIES("k11_profiles", f"WITH {YEARLY} SELECT 'row' AS axis, row AS at, round(avg(tp), 6) AS mean, round(stddev_samp(tp), 6) AS std FROM yearly GROUP BY row UNION ALL SELECT 'col', col, round(avg(tp), 6), round(stddev_samp(tp), 6) FROM yearly GROUP BY col")
def k11(spark, d):
    rows, cols = maps_with_profiles(yearly(spark, d), "tp")
    named = lambda df, a: df.select(F.lit(a).alias("axis"), F.col(a).alias("at"), r6("mean").alias("mean"), r6("std").alias("std"))
    return named(rows, "row").unionByName(named(cols, "col"))


@QUERIES("k12_drought_legacy", f"WITH {CONTRIBUTIONS}, s AS (SELECT year, heat < 0 AS drought, 100 * abs(spring) / nullif(abs(spring) + abs(summer) + abs(heat), 0) AS share FROM contrib) SELECT year, drought, round(avg(share), 6) AS mean, round(stddev_samp(share) / sqrt(count(share)), 6) AS sem FROM s GROUP BY 1, 2")
def k12(spark, d):
    c = contributions(spark, d).withColumn("drought", F.col("heat") < 0)
    return drought_legacy(c, "year", "drought", "spring", ["summer", "heat"]).select("year", "drought", r6("mean").alias("mean"), r6("sem").alias("sem"))


@QUERIES("k13_study_area", f"WITH {YEARLY}, {LANDCOVER}, {_MASK}, s AS (SELECT row // 4 AS row, col // 5 AS col, sum(keep) AS n FROM mask WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 4 * 4 FROM part) GROUP BY 1, 2), q AS (SELECT quantile_cont(n, 0.25) AS q FROM s WHERE n > 0), c AS (SELECT row // 4 AS row, col // 5 AS col, avg(value) AS v FROM yearly WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 4 * 4 FROM part) AND year = 1998 GROUP BY 1, 2) SELECT s.row::INT AS row, s.col::INT AS col, round(coalesce(CASE WHEN n > q THEN v END, -9999.0), 6) AS value FROM s CROSS JOIN q LEFT JOIN c ON c.row = s.row AND c.col = s.col")
def k13(spark, d):
    cells = coarsened(yearly(spark, d), ["year"], ["value"], 4, 5, *grid_size(spark, d)).withColumnRenamed("year", "season_year")
    counts = support(mask(spark, d), [], "keep", 4, 5, *grid_size(spark, d), more_than=-1)
    return study_area(cells, counts, "value", 1998).select("row", "col", r6("value").alias("value"))


@QUERIES("k14_phenology_stack", f"WITH {OBS}, r AS (SELECT row, col, year, CASE line % 4 WHEN 1 THEN 'sos' ELSE 'eos' END AS phase, dayofyear(ts) AS doy FROM obs WHERE line % 4 IN (1, 3)) SELECT row, col, year, phase, doy::INT AS doy, round(avg(doy) OVER (PARTITION BY row, col, phase), 6) AS baseline FROM r")
def k14(spark, d):
    records = obs(spark, d).select("row", "col", "year", (F.col("line") % 4).alias("band"), F.unix_date(F.to_date("ts")).alias("days_since_1970"))
    return phenology_stack(records, {1: "sos", 3: "eos"}).withColumn("baseline", r6("baseline"))
