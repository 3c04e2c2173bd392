"""Trends, fits, indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.functions.statistics import t_quantile
from verdancy.operators.cleaning import outer_halves
from verdancy.operators.trends import dependence_fit, effect_fit, spei, spei_rank, theil_sen, theil_sen_band, theil_sen_prediction_band, theil_sen_spatial, trend, trend_table, trend_with_t
from verdancy.queries.frames import CONTRIBUTIONS, OBS, Queries, contributions, obs, r6

QUERIES = Queries()

_FIT = """count(y)::BIGINT AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt, regr_r2(y, x) AS r2, avg(x) AS mx, regr_sxx(y, x) AS sxx,
  sqrt(greatest(regr_syy(y, x) - regr_sxy(y, x) ** 2 / nullif(regr_sxx(y, x), 0), 0) / nullif(count(y) - 2, 0)) AS s"""
_SERIES = "srs AS (SELECT row, year AS x, avg(value) AS y FROM obs GROUP BY 1, 2)"


def series(spark, d):
    return obs(spark, d).groupBy("row", F.col("year").alias("x")).agg(F.avg("value").alias("y"))


@QUERIES("h1_trend", f"WITH {OBS}, {_SERIES}, f AS (SELECT row, {_FIT} FROM srs GROUP BY row) SELECT row, n, round(slope, 6) AS slope, round(icpt, 4) AS intercept, round(r2, 6) AS r2, round(slope - 1.96 * s / sqrt(sxx), 6) AS ci_low, round(slope + 1.96 * s / sqrt(sxx), 6) AS ci_high FROM f")
def h1(spark, d):
    t = trend(series(spark, d), ["row"], "x", "y")
    return t.select("row", "n", r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r2").alias("r2"), r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


_BAND = "round(lo + (hi - lo) * k / {m}.0, 6) AS x, round(icpt + slope * (lo + (hi - lo) * k / {m}.0), 6) AS fit, round(icpt + slope * (lo + (hi - lo) * k / {m}.0) - 1.96 * s * sqrt(1 / n + (lo + (hi - lo) * k / {m}.0 - mx) ** 2 / sxx), 6) AS lower, round(icpt + slope * (lo + (hi - lo) * k / {m}.0) + 1.96 * s * sqrt(1 / n + (lo + (hi - lo) * k / {m}.0 - mx) ** 2 / sxx), 6) AS upper"


def _rounded(df, *by):
    return df.select(*by, "k", *(F.round(c, 6).alias(c) for c in ("x", "fit", "lower", "upper")))


@QUERIES("h2_fit_band", f"WITH {CONTRIBUTIONS}, f AS (SELECT region, {_FIT}, min(x) AS lo, max(x) AS hi FROM (SELECT region, heat AS y, value AS x FROM contrib) GROUP BY region) SELECT region, k::INT AS k, {_BAND.format(m=79)} FROM f, (SELECT unnest(range(0, 80)) AS k) WHERE n >= 3")
def h2(spark, d):
    return _rounded(effect_fit(contributions(spark, d), ["region"], "value", "heat", 80), "region")


_OUTER = "q AS (SELECT {by}, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM src GROUP BY {by}), o AS (SELECT src.* FROM src JOIN q USING ({by}) WHERE {x} <= q1 OR {x} >= q3), m AS (SELECT {by}, quantile_cont({x}, 0.5) AS med FROM o GROUP BY {by}), h AS (SELECT o.*, CASE WHEN {x} < med THEN 'low' ELSE 'high' END AS half FROM o JOIN m USING ({by}))"


@QUERIES("h3_dependence_fit", f"WITH {CONTRIBUTIONS}, src AS (SELECT region, heat AS x, spring AS y FROM contrib), {_OUTER.format(by='region', x='x')}, f AS (SELECT region, half, {_FIT}, min(x) AS lo, max(x) AS hi FROM h GROUP BY 1, 2) SELECT region, half, k::INT AS k, {_BAND.format(m=99)} FROM f, (SELECT unnest(range(0, 100)) AS k) WHERE n >= 3")
def h3(spark, d):
    c = contributions(spark, d).select("region", F.col("heat").alias("f"), F.col("spring").alias("c"))
    return _rounded(dependence_fit(c, ["region"], "f", "c", 100), "region", "half")


_PANEL = "UNION ALL ".join(f"SELECT '{s}' AS season, region, heat AS x, {s} AS y FROM contrib " for s in ("spring", "summer", "autumn", "winter"))


@QUERIES("h4_dependence_grid", f"WITH {CONTRIBUTIONS}, src AS ({_PANEL}), q AS (SELECT season, region, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM src GROUP BY 1, 2), o AS (SELECT src.* FROM src JOIN q USING (season, region) WHERE x <= q1 OR x >= q3), m AS (SELECT season, region, quantile_cont(x, 0.5) AS med FROM o GROUP BY 1, 2), h AS (SELECT o.*, CASE WHEN x < med THEN 'low' ELSE 'high' END AS half FROM o JOIN m USING (season, region)) SELECT season, region, half, count(*)::BIGINT AS n, round(regr_slope(y, x), 6) AS slope FROM h GROUP BY 1, 2, 3")
def h4(spark, d):
    c = contributions(spark, d).select("region", F.col("heat").alias("f"), "spring", "summer", "autumn", "winter")
    outer = outer_halves(c, "f", ["region"])  # those of each season, whose rows have the same f
    halves = outer.unpivot(["region", "f", "half"], ["spring", "summer", "autumn", "winter"], "season", "c")
    return trend(halves, ["season", "region", "half"], "f", "c").select("season", "region", "half", "n", r6("slope").alias("slope"))


_SHARES = "l AS (SELECT year, region, season, abs(phi) / nullif(t, 0) AS share FROM (UNPIVOT (SELECT year, region, abs(spring) + abs(summer) + abs(autumn) + abs(winter) AS t, spring, summer, autumn, winter FROM contrib) ON spring, summer, autumn, winter INTO NAME season VALUE phi)), w AS (SELECT year, region, season, avg(share) AS share FROM l GROUP BY ALL)"


def season_shares(spark, d):
    four = ["spring", "summer", "autumn", "winter"]
    c = contributions(spark, d).withColumn("t", sum((F.abs(F.col(s)) for s in four[1:]), F.abs(F.col("spring"))))
    long = c.select("year", "region", "t", *four).unpivot(["year", "region", "t"], four, "season", "phi")
    return long.groupBy("year", "region", "season").agg(F.avg(F.try_divide(F.abs("phi"), F.col("t"))).alias("share"))


@QUERIES("h5_trend_table", f"WITH {CONTRIBUTIONS}, {_SHARES}, f AS (SELECT region, season, {_FIT} FROM (SELECT region, season, year AS x, share AS y FROM w) GROUP BY 1, 2), g AS (SELECT season, regr_slope(share, year) AS gs FROM w GROUP BY 1) SELECT 'all' AS scenario, region, season, round(slope, 8) AS slope, round(slope - 1.96 * s / sqrt(sxx), 8) AS ci_low, round(slope + 1.96 * s / sqrt(sxx), 8) AS ci_high, round(gs, 8) AS global_slope, round(slope - gs, 8) AS delta_abs FROM f JOIN g USING (season)")
def h5(spark, d):
    t = trend_table(season_shares(spark, d).withColumn("scenario", F.lit("all")), "scenario", "region", "season", "year", "share")
    return t.select("scenario", "region", "season", *(F.round(c, 8).alias(c) for c in ("slope", "ci_low", "ci_high", "global_slope", "delta_abs")))


_T = ", ".join(f"({k}, {t_quantile(k)})" for k in range(1, 8))


@QUERIES("h6_latitude_trend", f"WITH {OBS}, {_SERIES}, tq(df, t) AS (VALUES {_T}), f AS (SELECT row, {_FIT} FROM srs GROUP BY row) SELECT row, round(slope, 6) AS slope, round(slope - t * s / sqrt(sxx), 6) AS ci_low, round(slope + t * s / sqrt(sxx), 6) AS ci_high FROM f JOIN tq ON df = greatest(n - 2, 1)")
def h6(spark, d):
    t = trend_with_t(series(spark, d), ["row"], "x", "y")
    return t.select("row", r6("slope").alias("slope"), r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@QUERIES("h7_theil_sen", f"WITH {OBS}, {_SERIES}, p AS (SELECT a.row, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM srs a JOIN srs b ON a.row = b.row AND b.x > a.x GROUP BY 1) SELECT row, round(slope, 6) AS slope, round(quantile_cont(y - slope * x, 0.5), 4) AS intercept FROM srs JOIN p USING (row) GROUP BY row, slope")
def h7(spark, d):
    return theil_sen(series(spark, d), ["row"], "x", "y").select("row", r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"))


@QUERIES("h7_spatial_median")
def h7_spatial(spark, d):
    return theil_sen_spatial(series(spark, d), ["row"], "x", "y")


_DRAWS = """rs AS (SELECT region, year AS x, avg(heat) AS y FROM contrib GROUP BY 1, 2), pts AS (SELECT region, x::DOUBLE AS x, y, row_number() OVER (PARTITION BY region ORDER BY x, y) AS j, count(*) OVER (PARTITION BY region) AS n FROM rs),
 places AS (SELECT region, n, rep, unnest(range(0, n)) AS i FROM (SELECT DISTINCT region, n FROM pts), (SELECT unnest(range(1, 1001)) AS rep)),
 picks AS (SELECT region, rep, ('0x' || substr(md5(concat_ws('|', 42, rep, i)), 1, 8))::BIGINT % n + 1 AS j FROM places), drawn AS (SELECT region, rep, x, y FROM picks JOIN pts USING (region, j)),
 sl AS (SELECT a.region, a.rep, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM drawn a JOIN drawn b ON a.region = b.region AND a.rep = b.rep AND b.x > a.x GROUP BY 1, 2),
 ic AS (SELECT region, rep, slope, quantile_cont(y - slope * x, 0.5) AS intercept FROM drawn JOIN sl USING (region, rep) GROUP BY ALL)"""


def regional_series(spark, d):
    return contributions(spark, d).groupBy("region", F.col("year").alias("x")).agg(F.avg("heat").alias("y"))


@QUERIES("h7_theil_sen_band", f"WITH {CONTRIBUTIONS}, {_DRAWS} SELECT region, round(quantile_cont(slope, 0.025), 6) AS low, round(quantile_cont(slope, 0.975), 6) AS high FROM sl GROUP BY 1")
def h7_band(spark, d):
    return theil_sen_band(regional_series(spark, d), ["region"], "x", "y").select("region", r6("low").alias("low"), r6("high").alias("high"))


@QUERIES("h7_prediction_band", f"WITH {CONTRIBUTIONS}, {_DRAWS}, ps AS (SELECT a.region, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM pts a JOIN pts b ON a.region = b.region AND b.x > a.x GROUP BY 1), pf AS (SELECT region, slope, quantile_cont(y - slope * x, 0.5) AS intercept FROM pts JOIN ps USING (region) GROUP BY ALL), b AS (SELECT region, x, quantile_cont(intercept + slope * x, 0.025) AS low, quantile_cont(intercept + slope * x, 0.975) AS high FROM ic JOIN pts USING (region) GROUP BY ALL) SELECT region, x, round(intercept + slope * x, 4) AS fit, round(low, 4) AS low, round(high, 4) AS high FROM b JOIN pf USING (region)")
def h7_prediction_band(spark, d):
    b = theil_sen_prediction_band(regional_series(spark, d), ["region"], "x", "y")
    return b.select("region", "x", *(F.round(c, 4).alias(c) for c in ("fit", "low", "high")))


@QUERIES("h8_effect_fit", f"WITH {CONTRIBUTIONS}, src AS ({_PANEL}), f AS (SELECT season, {_FIT}, min(x) AS lo, max(x) AS hi FROM src GROUP BY season) SELECT season, k::INT AS k, {_BAND.format(m=79)} FROM f, (SELECT unnest(range(0, 80)) AS k) WHERE n >= 3")
def h8(spark, d):
    long = contributions(spark, d).select(F.col("heat").alias("f"), "spring", "summer", "autumn", "winter").unpivot(["f"], ["spring", "summer", "autumn", "winter"], "season", "c")
    return _rounded(effect_fit(long, ["season"], "f", "c", 80), "season")


_MONTHS = "mon AS (SELECT row, year, month, sum(tp) - sum(vpd) AS water FROM obs GROUP BY ALL)"


def monthly(spark, d):
    return obs(spark, d).groupBy("row", "year", "month").agg((F.sum("tp") - F.sum("vpd")).alias("water"))


@QUERIES("h9_spei_rank", f"WITH {OBS}, {_MONTHS}, c AS (SELECT *, round(CASE WHEN count(water) OVER w = 3 THEN sum(water) OVER w END, 6) AS rolled FROM mon WINDOW w AS (PARTITION BY row ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT row, year, month, round((rank() OVER (PARTITION BY row, month ORDER BY rolled) - 0.44) / (count(*) OVER (PARTITION BY row, month) + 0.12), 6) AS position FROM c WHERE rolled IS NOT NULL")
def h9_rank(spark, d):
    return spei_rank(monthly(spark, d), ["row"], "year", "month", "water").select("row", "year", "month", r6("position").alias("position"))


@QUERIES("h9_spei")
def h9(spark, d):
    return spei(monthly(spark, d), ["row"], "year", "month", "water", calibration=(1995, 2001))
