"""Row expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.functions.scalars import absolute_share, cell_centre, cell_key, drought_lag, epoch_day_of_year, equation_label, midpoint, min_max, parsed_timestamp, pixel_index, record_years, row_mean, signed_share, vapour_pressure_deficit, window_label
from verdancy.operators.reshape import season_share
from verdancy.queries.frames import CONTRIBUTIONS, OBS, REGIONAL, Queries, contributions, obs, r6, regional, table

QUERIES = Queries()


@QUERIES("c1_epoch_day_of_year", f"WITH {OBS} SELECT ord, line, part, dayofyear(ts)::INT AS doy FROM obs")
def c1(spark, d):
    return obs(spark, d).select("ord", "line", "part", epoch_day_of_year(F.unix_date(F.to_date("ts"))).alias("doy"))


@QUERIES("c2_parsed_timestamp", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def c2(spark, d):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("unknown")
    return table(spark, d, "orders").select("o_orderkey", F.to_date(parsed_timestamp(text, "yyyy-MM-dd", "dd.MM.yyyy", "yyyyMMdd")).alias("day"))


@QUERIES("c3_midpoint", "SELECT o_custkey, floor((epoch(min(o_orderdate)) + epoch(max(o_orderdate))) / 2)::BIGINT AS mid FROM orders GROUP BY 1")
def c3(spark, d):
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.select("o_custkey", F.unix_timestamp(midpoint("a", "b")).alias("mid"))


@QUERIES("c4_record_years", "SELECT o_custkey, round_even(date_diff('day', min(o_orderdate), max(o_orderdate)) / 365, 0)::INT AS years FROM orders GROUP BY 1 HAVING years > 0")
def c4(spark, d):
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.select("o_custkey", record_years("a", "b").alias("years")).where("years > 0")


@QUERIES("c5_cell_key", f"WITH {REGIONAL} SELECT row || '_' || col || '_' || country AS gridid, count(*)::BIGINT AS n FROM regional GROUP BY 1")
def c5(spark, d):
    return regional(spark, d).groupBy(cell_key("row", "col", "country").alias("gridid")).agg(F.count("*").alias("n"))


_P = "(1013.25 * pow((273.16 + t) / (273.16 + t + 0.0065 * z), 5.625))"
_E = "(6.112 * (1 + 7e-4 + 3.46e-6 * {p}) * exp(17.67 * {x} / ({x} + 243.5)))"


@QUERIES("c6_vapour_pressure_deficit", f"WITH {OBS}, w AS (SELECT ord, line, part, value / 2 AS t, value / 2 - tp * 100 AS dew, row * 10.0 AS z FROM obs) SELECT ord, line, part, round({_E.format(p=_P, x='t')} - {_E.format(p=_P, x='dew')}, 6) AS vpd FROM w")
def c6(spark, d):
    t = F.col("value") / 2
    return obs(spark, d).select("ord", "line", "part", r6(vapour_pressure_deficit(t, t - F.col("tp") * 100, F.col("row") * 10.0)).alias("vpd"))


@QUERIES("c7_row_mean", f"WITH {OBS} SELECT ord, line, part, round((value + coalesce(x, 0) + vpd) / (2 + (x IS NOT NULL)::INT), 6) AS mean FROM (SELECT *, nullif(tp, 0.05) AS x FROM obs)")
def c7(spark, d):
    return obs(spark, d).select("ord", "line", "part", r6(row_mean("value", F.nullif("tp", F.lit(0.05)), "vpd")).alias("mean"))


_FOUR = ["spring", "summer", "autumn", "winter"]
_ALL = [*_FOUR, "heat"]
_SUM = lambda cols: " + ".join(f"abs({c})" for c in cols)


@QUERIES("c8a_signed_share", f"WITH {CONTRIBUTIONS} SELECT ord, line, row, col, " + ", ".join(f"round({c} / nullif({_SUM(_ALL)}, 0), 6) AS {c}" for c in _ALL) + " FROM contrib")
def c8a(spark, d):
    return contributions(spark, d).select("ord", "line", "row", "col", *(r6(signed_share(c, *_ALL)).alias(c) for c in _ALL))


@QUERIES("c8b_absolute_share", f"WITH {CONTRIBUTIONS} SELECT ord, line, row, col, " + ", ".join(f"round(abs({c}) / nullif({_SUM(_ALL)}, 0), 6) AS {c}" for c in _ALL) + " FROM contrib")
def c8b(spark, d):
    return contributions(spark, d).select("ord", "line", "row", "col", *(r6(absolute_share(c, *_ALL)).alias(c) for c in _ALL))


@QUERIES("c8c_season_share", f"WITH {CONTRIBUTIONS} SELECT ord, line, row, col, " + ", ".join(f"round(abs({c}) / nullif({_SUM(_FOUR)}, 0), 6) AS {c}" for c in _FOUR) + " FROM contrib")
def c8c(spark, d):
    return contributions(spark, d).select("ord", "line", "row", "col", *(r6(absolute_share(c, *_FOUR)).alias(c) for c in _FOUR))


@QUERIES("c8d_percent_share_long", f"WITH {CONTRIBUTIONS}, l AS (UNPIVOT (SELECT ord, line, row, col, spring, summer, autumn, winter FROM contrib) ON spring, summer, autumn, winter INTO NAME season VALUE phi) SELECT season, round(avg(s), 6) AS percent FROM (SELECT season, 100 * abs(phi) / nullif(sum(abs(phi)) OVER (PARTITION BY ord, line, row, col), 0) AS s FROM l) GROUP BY season")
def c8d(spark, d):
    keys = ["ord", "line", "row", "col"]
    long = contributions(spark, d).select(*keys, *_FOUR).unpivot(keys, _FOUR, "season", "phi")
    return season_share(long, keys, "phi").groupBy("season").agg(r6(F.avg(F.col("share") * 100)).alias("percent"))


@QUERIES("c9_legacy_share", f"WITH {CONTRIBUTIONS} SELECT year, round(avg(100 * abs(spring) / nullif(abs(spring) + abs(autumn) + abs(heat) + abs(winter), 0)), 6) AS lag_share FROM contrib GROUP BY year")
def c9(spark, d):
    share = absolute_share("spring", "spring", "autumn", "heat", "winter") * 100
    return contributions(spark, d).groupBy("year").agg(r6(F.avg(share)).alias("lag_share"))


@QUERIES("c10_drought_lag", f"WITH {CONTRIBUTIONS} SELECT ord, line, row, col, round(heat * (year - 1998), 6) AS lag FROM contrib")
def c10(spark, d):
    return contributions(spark, d).select("ord", "line", "row", "col", r6(drought_lag("heat", "year", 1998)).alias("lag"))


@QUERIES("c11_min_max", f"WITH {OBS}, e AS (SELECT min(tm) AS lo, max(tm) AS hi FROM obs) SELECT ord, line, part, round((tm - lo) / nullif(hi - lo, 0), 6) AS weight FROM obs, e")
def c11(spark, d):
    o = obs(spark, d)
    ends = o.agg(F.min("tm").alias("lo"), F.max("tm").alias("hi"))
    return o.crossJoin(F.broadcast(ends)).select("ord", "line", "part", r6(min_max("tm", "lo", "hi")).alias("weight"))


@QUERIES("c12_equation_label", f"WITH {CONTRIBUTIONS} SELECT region, format('y = {{:.3f}}x {{}} {{:.3f}}', slope, CASE WHEN icpt < 0 THEN '-' ELSE '+' END, abs(icpt)) AS label FROM (SELECT region, regr_slope(heat, value) AS slope, regr_intercept(heat, value) AS icpt FROM contrib GROUP BY region)")
def c12(spark, d):
    fits = contributions(spark, d).groupBy("region").agg(F.regr_slope("heat", "value").alias("s"), F.regr_intercept("heat", "value").alias("i"))
    return fits.select("region", equation_label("s", "i").alias("label"))


@QUERIES("c13_window_label", f"WITH {OBS} SELECT DISTINCT year || '-' || (year + 2) AS label FROM obs")
def c13(spark, d):
    return obs(spark, d).select(window_label("year", F.col("year") + 2).alias("label")).distinct()


@QUERIES("c14_pixel_index", f"WITH {OBS} SELECT ord, line, part, floor((tm - 900) / 2500)::INT AS idx FROM obs")
def c14(spark, d):
    return obs(spark, d).select("ord", "line", "part", pixel_index("tm", 900, 2500).alias("idx"))


@QUERIES("c15_cell_centre", f"WITH {OBS} SELECT DISTINCT col, round((-10.0 + (col + 0.5) * 0.25)::DOUBLE, 6) AS lon FROM obs")
def c15(spark, d):
    return obs(spark, d).select("col", r6(cell_centre("col", -10.0, 0.25)).alias("lon")).distinct()
