"""Joins on grids, by key and by computed index."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.functions.scalars import vapour_pressure_deficit
from verdancy.operators.cleaning import complete_stations
from verdancy.operators.grid import GridSpec, block_of, category_at, footprint, forest_mask, mosaic, nearest_irregular, nearest_lookup, nearest_valid, rectangles
from verdancy.operators.reshape import update_join
from verdancy.queries.frames import LANDCOVER, OBS, REGIONAL, ROWS, Queries, grid_size, landcover, obs, r6, regional, table
from verdancy.queries.summaries import _SHARE, shares

QUERIES = Queries()


@QUERIES("e1_equi_join", f"WITH {REGIONAL}, a AS (SELECT row, col, country, region, avg(value) AS v FROM regional GROUP BY ALL), b AS (SELECT row, col, country, region, avg(tp) AS t FROM regional WHERE year > 1998 GROUP BY ALL) SELECT row, col, country, region, round(v, 6) AS v, round(t, 6) AS t FROM a JOIN b USING (row, col, country, region)")
def e1(spark, d):
    keys = ["row", "col", "country", "region"]
    a = regional(spark, d).groupBy(*keys).agg(r6(F.avg("value")).alias("v"))
    return a.join(regional(spark, d).where("year > 1998").groupBy(*keys).agg(r6(F.avg("tp")).alias("t")), keys)


@QUERIES("e2_station_attributes", "SELECT c_custkey, c_mktsegment, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def e2(spark, d):
    return table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").join(table(spark, d, "customer"), "c_custkey").select("c_custkey", "c_mktsegment", "o_orderkey")


@QUERIES("e3_update_join", f"WITH {LANDCOVER} SELECT row, col, round(CASE WHEN col % 3 = 0 THEN elev * 2 ELSE elev END, 6) AS elev FROM landcover")
def e3(spark, d):
    cells = landcover(spark, d).select("row", "col", "elev")
    new = cells.where("col % 3 = 0").select("row", "col", (F.col("elev") * 2).alias("elev"))
    return update_join(cells, new, ["row", "col"], ["elev"]).select("row", "col", r6("elev").alias("elev"))


@QUERIES("e4_keyed_columns", f"WITH {LANDCOVER} SELECT row, col, cls, elev FROM landcover")
def e4(spark, d):
    cells = landcover(spark, d)
    return cells.select("row", "col", "cls").join(cells.select("row", "col", "elev"), ["row", "col"])


@QUERIES("e5_nearest_grid", f"WITH {OBS} SELECT ord, line, part, least(greatest(floor((tm - 5000) / 10000 + 0.5), 0), 7)::INT AS cell, round(least(greatest(floor((tm - 5000) / 10000 + 0.5), 0), 7) * 10000 + 5000.0, 6) AS centre FROM obs")
def e5(spark, d):
    axis = spark.range(8).select(F.col("id").cast("int").alias("cell"), (F.col("id") * 10000 + 5000.0).alias("centre"))
    return nearest_lookup(obs(spark, d), axis, "tm", (5000.0, 10000.0, 8), "cell").select("ord", "line", "part", "cell", r6("centre").alias("centre"))


@QUERIES("e5_nearest_irregular", f"WITH {OBS}, a AS (SELECT unnest([0.0, 3.0, 10.0, 25.0, 26.0, 44.0]::DOUBLE[]) AS pos), n AS (SELECT value, arg_min(pos, {{'d': abs(pos - value), 'n': -pos}}) AS nearest FROM (SELECT DISTINCT value FROM obs), a GROUP BY value) SELECT ord, line, part, value, nearest FROM obs JOIN n USING (value)")
def e5_irregular(spark, d):
    axis = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in (0.0, 3.0, 10.0, 25.0, 26.0, 44.0)))).alias("pos"))
    return nearest_irregular(obs(spark, d), axis, "value", "pos", "nearest").select("ord", "line", "part", "value", "nearest")


@QUERIES("e6_footprint", f"WITH {LANDCOVER}, r AS (SELECT row, col, unnest(range(floor(row * 4.5)::BIGINT, floor((row + 1) * 4.5)::BIGINT + 1))::INT AS lrow FROM landcover) SELECT row, col, lrow, unnest(range(floor(col * 4.5)::BIGINT, floor((col + 1) * 4.5)::BIGINT + 1))::INT AS lcol FROM r")
def e6(spark, d):
    return footprint(landcover(spark, d).select("row", "col"), 4.5)


def spec(spark, d):
    return GridSpec(0.0, 2.0, 0.0, 1.0, grid_size(spark, d)[0], 25)


@QUERIES("e7_category_at", f"WITH {OBS}, {LANDCOVER}, p AS (SELECT ord, line, part, floor(value / 2)::INT AS col, floor(row)::INT AS row FROM obs) SELECT ord, line, part, region_id FROM p LEFT JOIN landcover l ON p.row = l.row AND p.col = l.col AND p.col < 25")
def e7(spark, d):
    points = obs(spark, d).select("ord", "line", "part", F.col("value").alias("x"), F.col("row").cast("double").alias("y"))
    return category_at(points, landcover(spark, d), spec(spark, d), "x", "y", "region_id").select("ord", "line", "part", "region_id")


_NEAREST = "nv AS (SELECT a.row, a.col, arg_min(b.region_id, {'d': (a.row - b.row) ** 2 + (a.col - b.col) ** 2, 'r': b.row, 'c': b.col}) AS region_id FROM landcover a JOIN landcover b ON b.region_id <> 15 WHERE a.region_id = 15 GROUP BY 1, 2)"


@QUERIES("e8_nearest_valid", f"WITH {LANDCOVER}, {_NEAREST} SELECT row, col, region_id FROM landcover WHERE region_id <> 15 UNION ALL SELECT l.row, l.col, nv.region_id FROM landcover l LEFT JOIN nv USING (row, col) WHERE l.region_id = 15")
def e8(spark, d):
    return nearest_valid(landcover(spark, d), "region_id", 15)


@QUERIES("e9_elevation_over_time", f"WITH {OBS}, {LANDCOVER}, w AS (SELECT ord, line, part, value / 2 AS t, value / 2 - 3 AS dew, elev AS z FROM obs JOIN landcover USING (row, col)) SELECT ord, line, part, round(6.112 * (1 + 7e-4 + 3.46e-6 * (1013.25 * pow((273.16 + t) / (273.16 + t + 0.0065 * z), 5.625))) * (exp(17.67 * t / (t + 243.5)) - exp(17.67 * dew / (dew + 243.5))), 6) AS vpd FROM w")
def e9(spark, d):
    both = obs(spark, d).join(landcover(spark, d).select("row", "col", "elev"), ["row", "col"])
    return both.select("ord", "line", "part", r6(vapour_pressure_deficit(F.col("value") / 2, F.col("value") / 2 - 3, "elev")).alias("vpd"))


@QUERIES("e10_enumeration", f"WITH {REGIONAL}, m AS (SELECT region, flag, avg(value) AS v FROM regional WHERE country = 'NATION_3' GROUP BY 1, 2) SELECT r_regionkey AS region, f.flag, round(v, 6) AS v FROM region CROSS JOIN (SELECT DISTINCT l_returnflag AS flag FROM lineitem) f LEFT JOIN m ON m.region = r_regionkey AND m.flag = f.flag")
def e10(spark, d):
    r = regional(spark, d)
    frame = table(spark, d, "region").select(F.col("r_regionkey").alias("region")).crossJoin(F.broadcast(r.select("flag").distinct()))
    m = r.where("country = 'NATION_3'").groupBy("region", "flag").agg(r6(F.avg("value")).alias("v"))
    return frame.join(m, ["region", "flag"], "left")


@QUERIES("e11_forest_mask", f"WITH {LANDCOVER}, {_SHARE} SELECT s.row, s.col, wanted, total, (wanted >= floor(total * 0.1) AND elev <= 1000)::INT AS keep FROM shares s JOIN landcover l ON s.row = l.row AND s.col = l.col")
def e11(spark, d):
    m = forest_mask(shares(spark, d), landcover(spark, d).select("row", "col", "elev"), 0.1, 1000)
    return m.select("row", "col", "wanted", "total", "keep")


@QUERIES("e12_excluded_stations", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(year(o_orderdate)) - min(year(o_orderdate)) + 1 - count(DISTINCT year(o_orderdate)) <= 1)")
def e12(spark, d):
    good = complete_stations(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")), 1, station="c_custkey")
    return table(spark, d, "customer").select("c_custkey").join(good, "c_custkey", "left_anti")


@QUERIES("g2_mosaic", f"WITH {OBS}, t AS (SELECT row, col, supp, max(nullif(value, 50)) AS v FROM obs GROUP BY ALL) SELECT row, col, arg_min(v, supp) FILTER (v IS NOT NULL) AS v FROM t GROUP BY 1, 2")
def g2(spark, d):
    t = obs(spark, d).groupBy("row", "col", "supp").agg(F.max(F.nullif("value", F.lit(50.0))).alias("v"))
    return mosaic(t, ["row", "col"], "v", "supp")


@QUERIES("g10_tiles", f"WITH {LANDCOVER} SELECT row, col, least(row // e, 3)::INT AS kept, CASE WHEN row // e < 4 THEN (row // e)::INT END AS trimmed FROM landcover, (SELECT greatest({ROWS}, max(row) + 1) // 4 AS e FROM landcover)")
def g10(spark, d):
    rows = grid_size(spark, d)[0]
    return landcover(spark, d).select("row", "col", block_of(F.col("row"), rows, 4).alias("kept"), block_of(F.col("row"), rows, 4, keep_rest=False).alias("trimmed"))


@QUERIES("g10_rectangles", f"WITH {OBS}, r AS (SELECT i, j, i * 20 AS west, (i + 1) * 20 AS east, j * 10 AS south, (j + 1) * 10 AS north FROM (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j)) SELECT i::INT AS i, j::INT AS j, count(*)::BIGINT AS n FROM r JOIN obs ON part % 100 >= west AND part % 100 < east AND value >= south AND value < north GROUP BY 1, 2")
def g10_rectangles(spark, d):
    boxes = rectangles(0.0, 100.0, 0.0, 50.0, 5, spark)
    o = obs(spark, d).select((F.col("part") % 100).alias("x"), "value", F.floor(F.col("part") % 100 / 20).cast("int").alias("i"), F.floor(F.col("value") / 10).cast("int").alias("j"))
    inside = (F.col("x") >= F.col("west")) & (F.col("x") < F.col("east")) & (F.col("value") >= F.col("south")) & (F.col("value") < F.col("north"))
    return o.join(F.broadcast(boxes), ["i", "j"]).where(inside).groupBy("i", "j").agg(F.count("*").alias("n"))
