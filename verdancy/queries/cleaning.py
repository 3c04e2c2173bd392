"""Projection, filters, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.functions.scalars import kelvin_to_celsius, metres_to_millimetres, region_number, scaled, without_nodata, without_plot_suffix
from verdancy.operators.cleaning import complete_cases, complete_stations, covers_event, cropped, cropped_and_masked, drought_split, drought_threshold, masked, median_split, outer_quantiles, renamed_by_pattern, season_columns
from verdancy.operators.tiles import masked_tiles, tiled, untiled
from verdancy.queries.frames import CONTRIBUTIONS, LANDCOVER, OBS, YEARLY, Queries, contributions, landcover, obs, r6, table, yearly

QUERIES = Queries()


@QUERIES("b1_scaled", f"WITH {OBS} SELECT part, ord, line, CASE WHEN value <> 50 THEN round(value * 0.0001, 6) END AS evi FROM obs")
def b1(spark, d):
    return obs(spark, d).select("part", "ord", "line", r6(scaled("value", 1e-4, 50)).alias("evi"))


@QUERIES("b2_nodata", f"WITH {LANDCOVER} SELECT row, col, CASE WHEN cls NOT IN (0, 28) THEN cls END AS cls FROM landcover")
def b2(spark, d):
    return landcover(spark, d).select("row", "col", without_nodata("cls", 0, 28).alias("cls"))


@QUERIES("b3_units", f"WITH {OBS} SELECT ord, line, part, round(value + 273.15 - 273.15, 6) AS celsius, round(tp * 1000, 6) AS millimetres FROM obs")
def b3(spark, d):
    return obs(spark, d).select("ord", "line", "part", r6(kelvin_to_celsius(F.col("value") + 273.15)).alias("celsius"), r6(metres_to_millimetres("tp")).alias("millimetres"))


@QUERIES("b4_complete_cases", f"WITH {OBS}, gaps AS (SELECT ord, line, part, nullif(tp, 0.05) AS tp, nullif(vpd, 0.0) AS vpd FROM obs) SELECT * FROM gaps WHERE tp IS NOT NULL AND vpd IS NOT NULL")
def b4(spark, d):
    return complete_cases(obs(spark, d).select("ord", "line", "part", F.nullif("tp", F.lit(0.05)).alias("tp"), F.nullif("vpd", F.lit(0.0)).alias("vpd")))


@QUERIES("b5_complete_subset", f"WITH {OBS} SELECT ord, line, tp FROM (SELECT ord, line, nullif(tp, 0.05) AS tp FROM obs) WHERE tp IS NOT NULL")
def b5(spark, d):
    return complete_cases(obs(spark, d).withColumn("tp", F.nullif("tp", F.lit(0.05))), ["ord", "line", "tp"])


@QUERIES("b6_renamed", f"WITH {OBS} SELECT part, max(tp) AS tp_winter, max(vpd) AS vpd_winter FROM obs GROUP BY part")
def b6(spark, d):
    return renamed_by_pattern(obs(spark, d).groupBy("part").agg(F.max("tp").alias("tp_chilling"), F.max("vpd").alias("vpd_chilling")), "chilling", "winter")


@QUERIES("b7_season_columns", f"WITH {CONTRIBUTIONS} SELECT ord, line, row, col, spring, winter FROM contrib")
def b7(spark, d):
    wide = contributions(spark, d).select("ord", "line", "row", "col", F.col("spring").alias("tp_spring_shap_value"), F.lit(0.0).alias("my_springlike"), F.col("winter").alias("TP_Winter_shap_value"))
    found = season_columns(wide, "shap_value")
    return wide.select("ord", "line", "row", "col", *(F.col(found[s]).alias(s) for s in ("spring", "winter")))


@QUERIES("b8_region_number", "SELECT p_partkey, coalesce(try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS INT), 0) AS region, coalesce(try_cast(regexp_extract(p_type, '([0-9]+)', 1) AS INT), 0) AS none FROM part")
def b8(spark, d):
    return table(spark, d, "part").select("p_partkey", region_number("p_brand").alias("region"), region_number("p_type").alias("none"))


@QUERIES("b9_plot_suffix", "SELECT n_name AS country, count(*)::BIGINT AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def b9(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    plots = s.select(F.concat("n_name", F.lit("_plot_"), (F.col("s_suppkey") % 4).cast("string")).alias("c"))
    return plots.groupBy(without_plot_suffix("c").alias("country")).agg(F.count("*").alias("n"))


@QUERIES("b10_excluded", f"WITH {LANDCOVER} SELECT row, col, region_id FROM landcover WHERE region_id NOT IN (1, 9)")
def b10(spark, d):
    return landcover(spark, d).where(~F.col("region_id").isin(1, 9)).select("row", "col", "region_id")


@QUERIES("b11_region", f"WITH {LANDCOVER} SELECT row, col, elev FROM landcover WHERE region_id = 3")
def b11(spark, d):
    return landcover(spark, d).where("region_id = 3").select("row", "col", "elev")


@QUERIES("b12_cropped", f"WITH {LANDCOVER} SELECT row, col, elev FROM landcover WHERE col BETWEEN 5 AND 20 AND row BETWEEN 1 AND 30")
def b12(spark, d):
    return cropped(landcover(spark, d), 5, 20, 1, 30, "col", "row").select("row", "col", "elev")


@QUERIES("b13_masked", f"WITH {OBS}, {LANDCOVER} SELECT ord, line, part, value FROM obs SEMI JOIN (SELECT * FROM landcover WHERE cls > 20) USING (row, col)")
def b13(spark, d):
    mask = landcover(spark, d).withColumn("keep", (F.col("cls") > 20).cast("int"))
    return masked(obs(spark, d), mask, ["row", "col"]).select("ord", "line", "part", "value")


@QUERIES("b13_tiled_mask", f"WITH {YEARLY}, {LANDCOVER} SELECT y.row, y.col, year, round(value, 6) AS value FROM yearly y JOIN landcover USING (row, col) WHERE cls > 9")
def b13_tiled(spark, d):
    mask = tiled(landcover(spark, d).select("row", "col", (F.col("cls") > 9).cast("int").alias("keep")), [], "keep")
    kept = masked_tiles(tiled(yearly(spark, d), ["year"], "value"), mask)
    return untiled(kept, ["year"], "value").select("row", "col", "year", r6("value").alias("value"))


@QUERIES("b14_cropped_masked", f"WITH {OBS}, {LANDCOVER} SELECT ord, line, part, CASE WHEN m.cls IS NOT NULL AND value NOT IN (1, 2) THEN value END AS value FROM obs LEFT JOIN (SELECT row, col, cls FROM landcover WHERE cls > 20) m USING (row, col) WHERE col BETWEEN 5 AND 20 AND row BETWEEN 1 AND 30")
def b14(spark, d):
    mask = landcover(spark, d).withColumn("keep", (F.col("cls") > 20).cast("int"))
    rows = obs(spark, d).withColumns({"lon": F.col("col"), "lat": F.col("row")})
    return cropped_and_masked(rows, mask.select("row", "col", "keep"), ["row", "col"], (5, 20, 1, 30), "value", [1.0, 2.0]).select("ord", "line", "part", "value")


for _season in ("spring", "summer", "autumn", "winter"):
    _others = [s for s in ("spring", "summer", "autumn", "winter") if s != _season]
    _wet = " AND ".join(f"{o} >= 0" for o in _others)

    @QUERIES(f"b15_drought_{_season}", f"WITH {CONTRIBUTIONS} SELECT ord, line, row, col, CASE WHEN {_season} < 0 THEN 'drought' ELSE 'normal' END AS phase FROM contrib WHERE {_wet}")
    def b15(spark, d, season=_season, others=tuple(_others)):
        return drought_split(contributions(spark, d), season, list(others)).select("ord", "line", "row", "col", "phase")


@QUERIES("b15_drought_annual", f"WITH {CONTRIBUTIONS} SELECT ord, line, row, col, CASE WHEN heat < 0 THEN 'drought' ELSE 'normal' END AS phase FROM contrib")
def b15_annual(spark, d):
    return drought_split(contributions(spark, d), "heat", []).select("ord", "line", "row", "col", "phase")


@QUERIES("b16_drought_threshold", f"WITH {CONTRIBUTIONS}, low AS (SELECT region, min(heat) AS m FROM contrib GROUP BY region) SELECT region, round(quantile_cont(heat, 0.25), 6) AS threshold FROM contrib JOIN low USING (region) WHERE heat > m GROUP BY region")
def b16(spark, d):
    return drought_threshold(contributions(spark, d), "heat", ["region"]).select("region", r6("threshold").alias("threshold"))


@QUERIES("b17_outer_quantiles", f"WITH {CONTRIBUTIONS}, q AS (SELECT region, quantile_cont(heat, 0.25) AS lo, quantile_cont(heat, 0.75) AS hi FROM contrib GROUP BY region) SELECT ord, line, row, col, region FROM contrib JOIN q USING (region) WHERE heat <= lo OR heat >= hi")
def b17(spark, d):
    return outer_quantiles(contributions(spark, d), "heat", ["region"]).select("ord", "line", "row", "col", "region")


@QUERIES("b18_median_split", f"WITH {CONTRIBUTIONS}, q AS (SELECT region, quantile_cont(spring, 0.5) AS m FROM contrib GROUP BY region) SELECT region, CASE WHEN spring < m THEN 'low' ELSE 'high' END AS half, count(*)::BIGINT AS n FROM contrib JOIN q USING (region) GROUP BY 1, 2")
def b18(spark, d):
    return median_split(contributions(spark, d), "spring", ["region"]).groupBy("region", "half").agg(F.count("*").alias("n"))


@QUERIES("b18_median_split_overlap", f"WITH {CONTRIBUTIONS}, q AS (SELECT region, quantile_cont(spring, 0.5) AS m FROM contrib GROUP BY region), b AS (SELECT region, 'low' AS half FROM contrib JOIN q USING (region) WHERE spring <= m UNION ALL SELECT region, 'high' FROM contrib JOIN q USING (region) WHERE spring >= m) SELECT region, half, count(*)::BIGINT AS n FROM b GROUP BY 1, 2")
def b18_overlap(spark, d):
    return median_split(contributions(spark, d), "spring", ["region"], overlap=True).groupBy("region", "half").agg(F.count("*").alias("n"))


@QUERIES("b19_covers_event", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING min(o_orderdate)::DATE <= DATE '1998-06-01' - 365 * 2 AND max(o_orderdate)::DATE >= DATE '1998-06-01' + 365 * 2")
def b19(spark, d):
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    return spans.where(covers_event("start", "end", "1998-06-01", 2)).select("o_custkey")


@QUERIES("b20_complete_stations", "SELECT o_custkey AS s_id, (max(year(o_orderdate)) - min(year(o_orderdate)) + 1 - count(DISTINCT year(o_orderdate)))::BIGINT AS missing FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1 HAVING missing <= 2")
def b20(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'")
    return complete_stations(o.select(F.col("o_custkey").alias("s_id"), F.year("o_orderdate").alias("year")))
