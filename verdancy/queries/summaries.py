"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.operators.aggregates import annual_means, baseline, box_whiskers, chilling_days, classed, degree_days, density_2d, histogram, natural_breaks, regression_metrics, robust_range, slice_means, smoothed_density, station_extent, symmetric_limit, thornthwaite_pet, whisker_summary, zonal_profile
from verdancy.operators.calendar import SEASONS, same_year_winter, seasonal_means
from verdancy.operators.grid import GridSpec, class_share, coarsened, scaffold, support
from verdancy.operators.regrid import area_weights, class_areas, regridded
from verdancy.operators.tiles import blocks_of, coarsened_tiles, tiled, write_cube
from verdancy.queries.frames import CONTRIBUTIONS, LANDCOVER, OBS, REGIONAL, YEARLY, Queries, contributions, grid_size, landcover, obs, r6, regional, scratch, table, yearly

QUERIES = Queries()
SEASON_LIST = ["annual", "spring", "summer", "autumn", "winter", "winter_cross", "summer_half", "winter_half", "chilling"]


def season_sql(names: list[str]) -> str:
    rows = ", ".join(f"('{s}', {a}, {b}, {shift})" for s in names for a, b, shift in SEASONS[s])
    return f"cal(season, a, b, shift) AS (VALUES {rows})"


@QUERIES("d1_annual_means", f"WITH {OBS} SELECT row, col, year, round(avg(value), 6) AS value FROM obs GROUP BY ALL")
def d1(spark, d):
    return annual_means(obs(spark, d), ["row", "col"], "ts", "value").withColumn("value", r6("value"))


@QUERIES(
    "d2_slice_means",
    f"""WITH {OBS}, s AS (SELECT row, year, ord, nullif(value, 7) AS v FROM obs), flat AS (SELECT year, ord FROM s GROUP BY 1, 2 HAVING min(v) = max(v) OR min(v) IS NULL)
SELECT row, year, round(CASE WHEN count(v) = count(*) THEN sum(v) / count(*) END, 6) AS v FROM s ANTI JOIN flat USING (year, ord) GROUP BY 1, 2""",
)
def d2(spark, d):
    s = obs(spark, d).select("row", "year", "ord", F.nullif("value", F.lit(7.0)).alias("v"))
    return slice_means(s, ["row"], "year", "ord", "v").withColumn("v", r6("v"))


@QUERIES("d3_seasonal_means", f"WITH {OBS}, {season_sql(SEASON_LIST)} SELECT row, col, season, (year + shift)::INT AS season_year, round(avg(value), 6) AS value, round(avg(tp), 6) AS tp FROM obs JOIN cal ON month * 100 + day(ts) BETWEEN a AND b GROUP BY ALL")
def d3(spark, d):
    s = seasonal_means(obs(spark, d), ["row", "col"], "ts", ["value", "tp"], SEASON_LIST)
    return s.select("row", "col", "season", "season_year", r6("value").alias("value"), r6("tp").alias("tp"))


@QUERIES("d4_same_year_winter", f"WITH {OBS} SELECT row, col, year, round(avg(tp), 6) AS tp FROM obs WHERE month IN (1, 2, 12) GROUP BY ALL")
def d4(spark, d):
    return same_year_winter(obs(spark, d), ["row", "col"], "ts", ["tp"]).withColumn("tp", r6("tp"))


_HOURLY = "h AS (SELECT user_id, ts, CASE WHEN event_type <> 'error' THEN value - 45 END AS t FROM events)"


def hourly(spark, d):
    return table(spark, d, "events").select("user_id", "ts", F.when(F.col("event_type") != "error", F.col("value") - 45).alias("t"))


@QUERIES("d5_degree_days", f"WITH {_HOURLY} SELECT user_id, ts::DATE AS day, round(greatest(coalesce((max(t) + min(t)) / 2 - 5, 0), 0), 6) AS gdd FROM h GROUP BY 1, 2")
def d5(spark, d):
    return degree_days(hourly(spark, d), ["user_id"], "ts", "t").withColumn("gdd", r6("gdd"))


@QUERIES("d6_chilling_days", f"WITH {_HOURLY} SELECT user_id, ts::DATE AS day, CASE WHEN avg(t) < 5 THEN 1 WHEN avg(t) >= 5 THEN 0 END AS chilling FROM h GROUP BY 1, 2")
def d6(spark, d):
    return chilling_days(hourly(spark, d), ["user_id"], "ts", "t")


@QUERIES("d7_period_sums", f"WITH {_HOURLY}, g AS (SELECT user_id, ts::DATE AS day, greatest(coalesce((max(t) + min(t)) / 2 - 5, 0), 0) AS gdd, CASE WHEN avg(t) < 5 THEN 1 WHEN avg(t) >= 5 THEN 0 END AS c FROM h GROUP BY 1, 2) SELECT user_id, round(sum(gdd), 6) AS gdd, sum(c)::BIGINT AS chillingdays FROM g GROUP BY 1")
def d7(spark, d):
    h = hourly(spark, d)
    both = degree_days(h, ["user_id"], "ts", "t").join(chilling_days(h, ["user_id"], "ts", "t"), ["user_id", "day"])
    return both.groupBy("user_id").agg(r6(F.sum("gdd")).alias("gdd"), F.sum("chilling").alias("chillingdays"))


@QUERIES("d8_baseline", f"WITH {YEARLY} SELECT row, col, round(avg(value), 6) AS baseline FROM yearly GROUP BY 1, 2")
def d8(spark, d):
    return baseline(yearly(spark, d), ["row", "col"], "value").withColumn("baseline", r6("baseline"))


_SHARE = """fp AS (SELECT r.row, c.col, l.cls FROM (SELECT unnest(range(0, (SELECT floor(greatest(42, max(p_partkey) // 50 + 1) / 4.5)::BIGINT FROM part))) AS row) r, (SELECT unnest(range(0, 11)) AS col) c JOIN landcover l
  ON l.row BETWEEN floor(r.row * 4.5) AND floor((r.row + 1) * 4.5) AND l.col BETWEEN floor(c.col * 4.5) AND floor((c.col + 1) * 4.5)),
counts AS (SELECT row, col, cls, count(*) AS n FROM fp GROUP BY ALL),
shares AS (SELECT row::INT AS row, col::INT AS col, sum(CASE WHEN cls IN (23, 24, 25) THEN n ELSE 0 END)::BIGINT AS wanted, sum(n)::BIGINT AS total, arg_max(cls, {'n': n, 'c': -cls}) AS dominant FROM counts GROUP BY ALL)"""


def shares(spark, d):
    fine = landcover(spark, d).select(F.col("row").alias("lrow"), F.col("col").alias("lcol"), "cls")
    return class_share(fine, scaffold(spark, int(grid_size(spark, d)[0] / 4.5), 11), 4.5, [23, 24, 25])


@QUERIES("d9_class_share", f"WITH {LANDCOVER}, {_SHARE} SELECT * FROM shares")
def d9(spark, d):
    return shares(spark, d)


@QUERIES("d10_coarsened_mean", f"WITH {YEARLY} SELECT year, (row // 4)::INT AS row, (col // 6)::INT AS col, round(avg(value), 6) AS value FROM yearly WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 4 * 4 FROM part) AND col < 48 GROUP BY ALL")
def d10(spark, d):
    return coarsened(yearly(spark, d), ["year"], ["value"], 4, 6, *grid_size(spark, d)).withColumn("value", r6("value"))


def _overlap_sql(cells: str, height: float, width: float) -> str:
    """Shares of cells of size 1 in coarse cells of another size, for every cell of a table."""
    def axis(name: str, of: str, size: float) -> str:
        return f"""{name} AS (SELECT i, j, least(i + 1.0, (j + 1) * {size}) - greatest(i::DOUBLE, j * {size}) AS w
          FROM (SELECT i, unnest(range(floor(i / {size} + 1e-9)::BIGINT, ceil((i + 1) / {size} - 1e-9)::BIGINT)) AS j FROM (SELECT DISTINCT {of} AS i FROM {cells})))"""
    return axis("rs", "row", height) + ", " + axis("cs", "col", width)


def _coarse(spark, d, height: float, width: float) -> tuple[GridSpec, GridSpec]:
    rows, cols = grid_size(spark, d)
    return GridSpec(0.0, 1.0, 0.0, 1.0, rows, cols), GridSpec(0.0, width, 0.0, height, -int(-rows // height), -int(-cols // width))


@QUERIES("d10_tiled_mean", f"WITH {YEARLY} SELECT year, (row // 4)::INT AS row, (col // 6)::INT AS col, round(avg(value), 6) AS value FROM yearly GROUP BY ALL")
def d10_tiled(spark, d):
    """Years are bands of a cube of tiles, which is written and read back; blocks are averaged inside tiles."""
    path = scratch(spark)
    write_cube(tiled(yearly(spark, d), ["year"], "value"), path, ["year"])
    cube = spark.read.schema("trow int, tcol int, cells array<double>, year int").parquet(path)
    return blocks_of(coarsened_tiles(cube, 4, 6), ["year"], "value", 4, 6).withColumn("value", r6("value"))


@QUERIES("d10_regridded_mean", f"WITH {YEARLY}, {_overlap_sql('yearly', 3.7, 6.4)} SELECT year, rs.j::INT AS row, cs.j::INT AS col, round(sum(value * rs.w * cs.w) / sum(rs.w * cs.w), 6) AS value FROM yearly JOIN rs ON rs.i = row JOIN cs ON cs.i = col GROUP BY 1, 2, 3")
def d10_regridded(spark, d):
    return regridded(yearly(spark, d), ["year"], ["value"], *_coarse(spark, d, 3.7, 6.4)).withColumn("value", r6("value"))


_MASK = "mask AS (SELECT row, col, (cls > 9)::INT AS keep FROM landcover)"


def mask(spark, d):
    return landcover(spark, d).select("row", "col", (F.col("cls") > 9).cast("int").alias("keep"))


@QUERIES("d11_coarsened_sum", f"WITH {LANDCOVER}, {_MASK} SELECT (row // 4)::INT AS row, (col // 5)::INT AS col, sum(keep)::BIGINT AS n, round(sum(keep) / 20, 6) AS weights FROM mask WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 4 * 4 FROM part) GROUP BY 1, 2")
def d11(spark, d):
    return coarsened(mask(spark, d), [], ["keep"], 4, 5, *grid_size(spark, d), "sum").select("row", "col", F.col("keep").alias("n"), r6(F.col("keep") / 20).alias("weights"))


@QUERIES("d11_regridded_sum", f"WITH {LANDCOVER}, {_MASK}, {_overlap_sql('mask', 3.7, 6.4)} SELECT rs.j::INT AS row, cs.j::INT AS col, round(sum(keep * rs.w * cs.w), 6) AS n, round(sum(keep * rs.w * cs.w) / 23.68, 6) AS weights FROM mask JOIN rs ON rs.i = row JOIN cs ON cs.i = col GROUP BY 1, 2 HAVING sum(keep * rs.w * cs.w) > 1")
def d11_regridded(spark, d):
    return area_weights(mask(spark, d), "keep", *_coarse(spark, d, 3.7, 6.4), 1.0).select("row", "col", r6("n").alias("n"), r6("weights").alias("weights"))


@QUERIES("d9_class_areas", f"WITH {LANDCOVER}, {_overlap_sql('landcover', 2.5, 4.2)}, a AS (SELECT rs.j::INT AS row, cs.j::INT AS col, cls, round(sum(rs.w * cs.w), 9) AS a FROM landcover JOIN rs ON rs.i = row JOIN cs ON cs.i = col GROUP BY 1, 2, 3) SELECT row, col, round(coalesce(sum(a) FILTER (cls IN (3, 4, 5)), 0), 6) AS wanted, round(sum(a), 6) AS total, arg_max(cls, {{'a': a, 'c': -cls}}) AS dominant FROM a GROUP BY 1, 2")
def d9_areas(spark, d):
    a = class_areas(landcover(spark, d), [3, 4, 5], *_coarse(spark, d, 2.5, 4.2))
    return a.select("row", "col", r6("wanted").alias("wanted"), r6("total").alias("total"), "dominant")


@QUERIES("d12_support", f"WITH {LANDCOVER}, {_MASK} SELECT (row // 4)::INT AS row, (col // 5)::INT AS col, sum(keep)::BIGINT AS n, round(sum(keep) / 20, 6) AS weights FROM mask WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 4 * 4 FROM part) GROUP BY 1, 2 HAVING sum(keep) > 12")
def d12(spark, d):
    return support(mask(spark, d), [], "keep", 4, 5, *grid_size(spark, d), more_than=12).withColumn("weights", r6("weights"))


@QUERIES("d12_support_quantile", f"WITH {LANDCOVER}, {_MASK}, s AS (SELECT row // 4 AS row, col // 5 AS col, sum(keep) AS n FROM mask WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 4 * 4 FROM part) GROUP BY 1, 2), q AS (SELECT quantile_cont(n, 0.25) AS q FROM s WHERE n > 0) SELECT row::INT AS row, col::INT AS col, n::BIGINT AS n FROM s, q WHERE n > q")
def d12_quantile(spark, d):
    n = support(mask(spark, d), [], "keep", 4, 5, *grid_size(spark, d), more_than=-1)
    q = n.where("n > 0").agg(F.percentile("n", 0.25).alias("q"))
    return n.crossJoin(F.broadcast(q)).where("n > q").select("row", "col", "n")


@QUERIES("d13_window_mean", f"WITH {CONTRIBUTIONS} SELECT year, round(avg(abs(spring) / nullif(abs(spring) + abs(summer) + abs(autumn) + abs(winter), 0)), 6) AS share FROM contrib GROUP BY year")
def d13(spark, d):
    total = F.abs("spring") + F.abs("summer") + F.abs("autumn") + F.abs("winter")
    return contributions(spark, d).groupBy("year").agg(r6(F.avg(F.try_divide(F.abs("spring"), total))).alias("share"))


@QUERIES("d14_mean_sem", f"WITH {CONTRIBUTIONS} SELECT year, heat < 0 AS drought, round(avg(spring), 6) AS mean, round(stddev_samp(spring) / sqrt(count(spring)), 6) AS sem FROM contrib GROUP BY 1, 2")
def d14(spark, d):
    c = contributions(spark, d).withColumn("drought", F.col("heat") < 0)
    return c.groupBy("year", "drought").agg(r6(F.avg("spring")).alias("mean"), r6(F.stddev_samp("spring") / F.sqrt(F.count("spring"))).alias("sem"))


@QUERIES("d15_box_whiskers", f"WITH {CONTRIBUTIONS}, b AS (SELECT region, quantile_cont(heat, 0.25) AS q1, quantile_cont(heat, 0.5) AS median, quantile_cont(heat, 0.75) AS q3 FROM contrib GROUP BY region) SELECT region, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(heat), 6) AS whisker_low, round(max(heat), 6) AS whisker_high FROM contrib JOIN b USING (region) WHERE heat BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY region")
def d15(spark, d):
    b = box_whiskers(contributions(spark, d), ["region"], "heat")
    return b.select("region", *(r6(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")))


@QUERIES("d16_whisker_summary", f"WITH {OBS}, s AS (SELECT part, year, count(value) AS n, avg(value) AS m, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.95) AS c FROM obs GROUP BY 1, 2) SELECT part, year, n::BIGINT AS n, round(m, 6) AS mean, round(CASE WHEN n < 3 OR a = c THEN m - 0.01 ELSE a END, 6) AS q05, round(CASE WHEN n < 3 OR a = c THEN m ELSE b END, 6) AS q50, round(CASE WHEN n < 3 OR a = c THEN m + 0.01 ELSE c END, 6) AS q95 FROM s")
def d16(spark, d):
    s = whisker_summary(obs(spark, d), ["part", "year"], "value")
    return s.select("part", "year", "n", *(r6(c).alias(c) for c in ("mean", "q05", "q50", "q95")))


@QUERIES("d17_robust_range", f"WITH {OBS} SELECT year, round(quantile_cont(tm, 0.02), 6) AS low, round(quantile_cont(tm, 0.98), 6) AS high FROM obs GROUP BY year")
def d17(spark, d):
    return robust_range(obs(spark, d), ["year"], "tm").select("year", r6("low").alias("low"), r6("high").alias("high"))


@QUERIES("d18_annual_series", f"WITH {REGIONAL} SELECT region, year, round(avg(value), 6) AS mean, year IN (1996, 1999) AS drought FROM regional GROUP BY region, year")
def d18(spark, d):
    return regional(spark, d).groupBy("region", "year").agg(r6(F.avg("value")).alias("mean")).withColumn("drought", F.col("year").isin(1996, 1999))


@QUERIES("d19_zonal_profile", f"WITH {YEARLY} SELECT row, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM yearly GROUP BY row")
def d19(spark, d):
    return zonal_profile(yearly(spark, d), "row", "value").select("row", r6("mean").alias("mean"), r6("std").alias("std"))


@QUERIES("d20_histogram", f"WITH {OBS}, b AS (SELECT least(floor((tm - 900) / 100000 * 40), 39)::INT AS bin FROM obs WHERE tm BETWEEN 900 AND 100900) SELECT bin, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER () / 2500, 9) AS density FROM b GROUP BY bin")
def d20(spark, d):
    return histogram(obs(spark, d), "tm", 900, 100900).withColumn("density", F.round("density", 9))


@QUERIES("d21_density_2d", f"WITH {OBS} SELECT least(floor((tm - 900) / 100000 * 50), 49)::INT AS bx, least(floor((value - 0) / 50 * 50), 49)::INT AS \"by\", count(*)::BIGINT AS n FROM obs WHERE tm BETWEEN 900 AND 100900 AND value BETWEEN 0 AND 50 GROUP BY 1, 2")
def d21(spark, d):
    return density_2d(obs(spark, d), "tm", "value", (900, 100900), (0, 50))


@QUERIES("d21_smoothed_density")
def d21_smoothed(spark, d):
    return smoothed_density(contributions(spark, d), ["region"], "heat", "spring", 60)


@QUERIES("d22_regression_metrics", f"WITH {CONTRIBUTIONS} SELECT year AS fold, round(1 - avg((heat - spring) ** 2) / var_pop(heat), 6) AS r2, round(avg((heat - spring) ** 2), 6) AS mse, round(avg(abs(heat - spring)), 6) AS mae FROM contrib GROUP BY year")
def d22(spark, d):
    m = regression_metrics(contributions(spark, d).withColumnRenamed("year", "fold"), ["fold"], "heat", "spring")
    return m.select("fold", r6("r2").alias("r2"), r6("mse").alias("mse"), r6("mae").alias("mae"))


@QUERIES("d23_natural_breaks")
def d23(spark, d):
    o = obs(spark, d)
    breaks = natural_breaks(o, "tm", 5)
    return o.groupBy(classed(F.col("tm"), breaks).alias("class")).agg(F.count("*").alias("n"), F.min("tm").alias("low"), F.max("tm").alias("high"))


@QUERIES("d24_symmetric_limit", f"WITH {CONTRIBUTIONS} SELECT round(least(0.5, greatest(0.25, quantile_cont(p, 0.5))), 6) AS lim FROM (SELECT region, quantile_cont(abs(autumn / 50), 0.95) AS p FROM contrib GROUP BY region)")
def d24(spark, d):
    s = symmetric_limit(contributions(spark, d).withColumn("a", F.col("autumn") / 50), ["region"], "a")
    return s.select(r6("limit").alias("lim"))


@QUERIES("d25_station_extent", "SELECT o_custkey AS s_id, min(o_orderdate)::DATE AS start, max(o_orderdate)::DATE AS \"end\", arg_min(o_orderpriority, o_orderkey) AS phase FROM orders GROUP BY 1")
def d25(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("s_id"), "o_orderdate", "o_orderkey", F.col("o_orderpriority").alias("phase"))
    e = station_extent(o, "s_id", "o_orderdate", "o_orderdate", ["phase"], "o_orderkey")
    return e.select("s_id", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "phase")


@QUERIES("d26_thornthwaite_pet", f"WITH {OBS}, m AS (SELECT row, year, month, avg(value) - 20 AS t FROM obs GROUP BY ALL), h AS (SELECT *, coalesce(sum(CASE WHEN t > 0 THEN pow(t / 5, 1.514) END) OVER (PARTITION BY row, year), 0) AS i FROM m) SELECT row, year, month, round(CASE WHEN t > 0 THEN 16 * pow(10 * t / i, 6.75e-7 * pow(i, 3) - 7.71e-5 * pow(i, 2) + 1.792e-2 * i + 0.49239) ELSE 0 END, 4) AS pet FROM h")
def d26(spark, d):
    m = obs(spark, d).groupBy("row", "year", "month").agg((F.avg("value") - 20).alias("t"))
    return thornthwaite_pet(m, ["row"], "year", "t").select("row", "year", "month", F.round("pet", 4).alias("pet"))


@QUERIES("d27_valid_cells", f"WITH {LANDCOVER}, {_MASK}, s AS (SELECT row // 4 AS row, col // 5 AS col, sum(keep) AS n FROM mask WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 4 * 4 FROM part) GROUP BY 1, 2) SELECT r::INT AS row, c::INT AS col, (coalesce(n, 0) > 12)::INT AS valid, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 10)) AS r) CROSS JOIN (SELECT unnest(range(0, 10)) AS c) LEFT JOIN s ON row = r AND col = c")
def d27(spark, d):
    n = support(mask(spark, d), [], "keep", 4, 5, *grid_size(spark, d), more_than=-1)
    full = scaffold(spark, grid_size(spark, d)[0] // 4, 10).join(n, ["row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return full.select("row", "col", (F.col("n") > 12).cast("int").alias("valid"), "n")
