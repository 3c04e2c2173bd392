"""Panels over all seasons, drivers and datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.operators.calendar import seasonal_means
from verdancy.plans.panels import dependence_grid, season_classes, season_histograms, trend_anomaly_panels
from verdancy.queries.frames import CONTRIBUTIONS, OBS, REGIONAL, Queries, contributions, obs, r6, regional
from verdancy.queries.statistics import _BAND, _FIT, _OUTER, _rounded
from verdancy.queries.summaries import season_sql

QUERIES = Queries()
_FOUR = ["spring", "summer", "autumn", "winter"]
_CLIMATE = season_sql(_FOUR) + ", climate AS (SELECT row, col, season, (year + shift)::INT AS year, avg(tm) AS tm, avg(vpd) AS vpd FROM obs JOIN cal ON month * 100 + day(ts) BETWEEN a AND b GROUP BY ALL)"


def climate(spark, d):
    return seasonal_means(obs(spark, d), ["row", "col"], "ts", ["tm", "vpd"], _FOUR).withColumnRenamed("season_year", "year")


_TOTAL = " + ".join(f"abs({s})" for s in _FOUR)
_PANELS = f"""shares AS ({" UNION ALL ".join(f"SELECT '{s}' AS season, year AS window_start, avg(abs({s}) / nullif({_TOTAL}, 0)) AS share FROM contrib GROUP BY year" for s in _FOUR)}),
 base AS (SELECT row, col, season, avg(tm) AS bt, avg(vpd) AS bv FROM climate GROUP BY ALL),
 win AS (SELECT row, col, season, s AS window_start, avg(tm) AS tm, avg(vpd) AS vpd FROM climate JOIN (SELECT unnest(range(1995, 2000))::INT AS s) ON year BETWEEN s AND s + 2 GROUP BY ALL),
 z AS (SELECT season, window_start, avg(tm - bt) / stddev_samp(bt) AS tm, avg(vpd - bv) / stddev_samp(bv) AS vpd FROM win JOIN base USING (row, col, season) GROUP BY ALL),
 pts AS (SELECT season, 'trend' AS panel, window_start::DOUBLE AS x, share AS y FROM shares UNION ALL {" UNION ALL ".join(f"SELECT season, '{c}', {c}, share FROM shares JOIN z USING (season, window_start)" for c in ("tm", "vpd"))}),
 f AS (SELECT season, panel, {_FIT} FROM pts GROUP BY 1, 2)"""


@QUERIES("k9_season_panels", f"WITH {CONTRIBUTIONS}, {_CLIMATE}, {_PANELS} SELECT season, panel, n, round(slope, 6) AS slope, round(slope - 1.96 * s / sqrt(sxx), 6) AS ci_low, round(slope + 1.96 * s / sqrt(sxx), 6) AS ci_high FROM f")
def k9_panels(spark, d):
    c = contributions(spark, d).withColumn("window_start", F.col("year"))
    t = trend_anomaly_panels(c, climate(spark, d), ["row", "col"], _FOUR, ["tm", "vpd"], 1995, 2001)
    return t.select("season", "panel", "n", *(r6(x).alias(x) for x in ("slope", "ci_low", "ci_high")))


_BY = "scenario, driver, season"
_COLUMNS = {"spring": "value - 25", "summer": "(tp - 0.05) * 500", "autumn": "(ord % 11 - 5) * 5.0::DOUBLE", "winter": "(line - 4) * 5.0::DOUBLE"}
_LONG = " UNION ALL ".join(f"SELECT CASE WHEN line % 2 = 0 THEN 'evi' ELSE 'sif' END AS scenario, '{x}' AS driver, '{s}' AS season, {x} AS x, {y} AS y FROM regional" for x in ("tm", "vpd") for s, y in _COLUMNS.items())


@QUERIES("h4_dependence_panels", f"WITH {REGIONAL}, src AS ({_LONG}), {_OUTER.format(by=_BY, x='x')}, f AS (SELECT {_BY}, half, {_FIT}, min(x) AS lo, max(x) AS hi FROM h GROUP BY {_BY}, half) SELECT {_BY}, half, k::INT AS k, {_BAND.format(m=99)} FROM f, (SELECT unnest(range(0, 100)) AS k) WHERE n >= 3")
def h4_panels(spark, d):
    scenario = F.when(F.col("line") % 2 == 0, "evi").otherwise("sif")
    seasons = [(F.col("value") - 25).alias("spring"), ((F.col("tp") - 0.05) * 500).alias("summer"), ((F.col("ord") % 11 - 5) * 5.0).alias("autumn"), ((F.col("line") - 4) * 5.0).alias("winter")]
    grid = dependence_grid(regional(spark, d).select(scenario.alias("scenario"), "tm", "vpd", *seasons), ["scenario"], ["tm", "vpd"], _FOUR)
    return _rounded(grid, "scenario", "driver", "season", "half")


@QUERIES("k11_season_histograms", f"WITH {OBS}, {_CLIMATE}, b AS (SELECT season, least(floor((tm - 900) / 100000 * 40), 39)::INT AS bin FROM climate WHERE tm BETWEEN 900 AND 100900) SELECT season, bin, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY season) / 2500, 9) AS density FROM b GROUP BY season, bin")
def k11_histograms(spark, d):
    return season_histograms(climate(spark, d), "season", "tm", 900, 100900).withColumn("density", F.round("density", 9))


@QUERIES("k11_season_classes")
def k11_classes(spark, d):
    return season_classes(climate(spark, d), "season", "tm")
