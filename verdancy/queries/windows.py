"""Windows over years, reshaping, unions, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.operators.calendar import pooled_window, sliding_windows
from verdancy.operators.reshape import anomaly, first_per_key, grouped_sample, hashed_sample, long_to_wide, sign_runs, tagged_union, wide_to_long, zero_crossings
from verdancy.operators.grid import coarsened
from verdancy.operators.trends import window_anomaly
from verdancy.queries.frames import CONTRIBUTIONS, OBS, YEARLY, Queries, contributions, grid_size, obs, r6, r6_ties, table, yearly

QUERIES = Queries()
YEARS = list(range(1995, 2002))
_WINDOWS = "w AS (SELECT row, col, s AS window_start, s + {m} AS window_end, avg(value) AS value, avg(tp) AS tp FROM yearly JOIN (SELECT unnest(range(1995, {e}))::INT AS s) ON year BETWEEN s AND s + {m} GROUP BY ALL)"
WINDOW3 = _WINDOWS.format(m=2, e=2000)


@QUERIES("f1_sliding_windows", f"WITH {YEARLY}, {WINDOW3} SELECT row, col, window_start, window_end::INT AS window_end, round(value, 6) AS value, round(tp, 6) AS tp FROM w")
def f1(spark, d):
    w = sliding_windows(yearly(spark, d), ["row", "col"], "year", ["value", "tp"], 1995, 2001)
    return w.select("row", "col", "window_start", "window_end", r6("value").alias("value"), r6("tp").alias("tp"))


@QUERIES("f1_sliding_windows_of_5", f"WITH {YEARLY}, {_WINDOWS.format(m=4, e=1998)} SELECT row, col, window_start, window_end::INT AS window_end, round(value + 1e-10, 6) AS value, round(tp + 1e-10, 6) AS tp FROM w")
def f1_five(spark, d):
    w = sliding_windows(yearly(spark, d), ["row", "col"], "year", ["value", "tp"], 1995, 2001, 5)
    return w.select("row", "col", "window_start", "window_end", r6_ties("value").alias("value"), r6_ties("tp").alias("tp"))


@QUERIES("f2_pooled_windows", f"WITH {OBS} SELECT least((year - 1995) // 3, 1)::INT AS win, count(*)::BIGINT AS n, round(avg(value), 6) AS value FROM obs WHERE year < 2001 GROUP BY 1")
def f2(spark, d):
    o = obs(spark, d).where("year < 2001")
    return o.groupBy(pooled_window(F.col("year"), 1995, 2001).alias("win")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("value"))


@QUERIES("f3_anomaly", f"WITH {YEARLY}, a AS (SELECT row, col, year, value - avg(value) OVER (PARTITION BY row, col) AS x FROM yearly) SELECT year, (row // 4)::INT AS row, (col // 5)::INT AS col, round(avg(x), 6) AS anomaly FROM a WHERE row < (SELECT greatest(42, max(p_partkey) // 50 + 1) // 4 * 4 FROM part) GROUP BY ALL")
def f3(spark, d):
    return coarsened(anomaly(yearly(spark, d), ["row", "col"], "value"), ["year"], ["anomaly"], 4, 5, *grid_size(spark, d)).withColumn("anomaly", r6("anomaly"))


@QUERIES("f4_window_anomaly", f"WITH {YEARLY}, {WINDOW3}, b AS (SELECT row, col, avg(value) AS b FROM yearly GROUP BY 1, 2) SELECT window_start, round(avg(value - b) / stddev_samp(b), 6) AS z FROM w JOIN b USING (row, col) GROUP BY 1")
def f4(spark, d):
    y = yearly(spark, d)
    w = sliding_windows(y, ["row", "col"], "year", ["value"], 1995, 2001)
    return window_anomaly(w, y, ["row", "col"], "value", ["window_start"]).select("window_start", r6("z").alias("z"))


@QUERIES("f5_first_per_key", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def f5(spark, d):
    return first_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


_SERIES = "s AS (SELECT row, year, round(avg(value) - 25.5, 6) AS y FROM obs GROUP BY 1, 2)"


def series(spark, d):
    return obs(spark, d).groupBy("row", "year").agg(r6(F.avg("value") - 25.5).alias("y"))


@QUERIES("f6_zero_crossings", f"WITH {OBS}, {_SERIES}, l AS (SELECT *, lag(year) OVER w AS x0, lag(y) OVER w AS y0 FROM s WINDOW w AS (PARTITION BY row ORDER BY year)) SELECT row, year::DOUBLE AS year, y FROM s UNION ALL SELECT row, round(x0 - y0 / (y - y0) * (year - x0), 6), 0.0 FROM l WHERE y0 * y < 0")
def f6(spark, d):
    return zero_crossings(series(spark, d), ["row"], "year", "y").withColumn("year", r6("year"))


@QUERIES("f7_sign_runs", f"WITH {OBS}, {_SERIES}, l AS (SELECT *, sign(y)::INT AS sign, CASE WHEN sign(y) = lag(sign(y)) OVER (PARTITION BY row ORDER BY year) THEN 0 ELSE 1 END AS fresh FROM s), g AS (SELECT *, sum(fresh) OVER (PARTITION BY row ORDER BY year) AS run FROM l) SELECT row, run::BIGINT AS run, sign, min(year) AS first, max(year) AS last, count(*)::BIGINT AS points FROM g GROUP BY 1, 2, 3")
def f7(spark, d):
    return sign_runs(series(spark, d), ["row"], "year", "y")


@QUERIES("f8_deviation", f"WITH {CONTRIBUTIONS}, s AS (SELECT region, abs(spring) / nullif(abs(spring) + abs(summer), 0) AS share FROM contrib) SELECT region, round(avg(share) - (SELECT avg(share) FROM s), 6) AS delta FROM s GROUP BY region")
def f8(spark, d):
    s = contributions(spark, d).select("region", F.try_divide(F.abs("spring"), F.abs("spring") + F.abs("summer")).alias("share"))
    whole = s.agg(F.avg("share").alias("overall"))
    return s.groupBy("region").agg(F.avg("share").alias("m")).crossJoin(F.broadcast(whole)).select("region", r6(F.col("m") - F.col("overall")).alias("delta"))


@QUERIES("f9_melted", f"WITH {CONTRIBUTIONS} SELECT season, count(*)::BIGINT AS n, round(avg(v), 6) AS mean FROM (UNPIVOT (SELECT ord, spring, summer, autumn, winter FROM contrib) ON spring, summer, autumn, winter INTO NAME season VALUE v) GROUP BY season")
def f9(spark, d):
    long = contributions(spark, d).select("ord", "spring", "summer", "autumn", "winter").unpivot(["ord"], ["spring", "summer", "autumn", "winter"], "season", "v")
    return long.groupBy("season").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean"))


@QUERIES("f10_wide_to_long", f"WITH {YEARLY} SELECT c.row, c.col, y::INT AS year, round(value, 6) AS value, round(tp, 6) AS tp FROM (SELECT DISTINCT row, col FROM yearly) c CROSS JOIN (SELECT unnest(range(1995, 2002)) AS y) LEFT JOIN yearly ON yearly.row = c.row AND yearly.col = c.col AND year = y")
def f10(spark, d):
    wide = long_to_wide(yearly(spark, d), ["row", "col"], "year", YEARS, ["value", "tp"])
    return wide_to_long(wide, ["row", "col"], years=YEARS).select("row", "col", "year", r6("value").alias("value"), r6("tp").alias("tp"))


@QUERIES("f11_long_to_wide", f"WITH {YEARLY} SELECT row, col, " + ", ".join(f"round(max(value) FILTER (year = {y}), 6) AS value_{y}" for y in YEARS) + " FROM yearly GROUP BY 1, 2")
def f11(spark, d):
    return long_to_wide(yearly(spark, d).withColumn("value", r6("value")), ["row", "col"], "year", YEARS, ["value"])


@QUERIES("f12_region_order", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 1 WHEN 4 THEN 3 END AS rank FROM nation")
def f12(spark, d):
    ranks = {0: 4, 1: 2, 2: 5, 3: 1, 4: 3}  # driest region first
    order = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))
    return table(spark, d, "nation").select("n_nationkey", F.element_at(order, F.col("n_regionkey")).alias("rank"))


@QUERIES("g1_tagged_union", "SELECT 'even' AS country, s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'odd', s_suppkey, NULL FROM supplier WHERE s_suppkey % 2 = 1")
def g1(spark, d):
    s = table(spark, d, "supplier")
    return tagged_union({"even": s.where("s_suppkey % 2 = 0").select("s_suppkey", "s_acctbal"), "odd": s.where("s_suppkey % 2 = 1").select("s_suppkey")}, "country")


@QUERIES("g3_drop_duplicates", f"WITH {OBS} SELECT part, supp, min(ord) AS ord FROM obs GROUP BY 1, 2")
def g3(spark, d):
    return first_per_key(obs(spark, d).select("part", "supp", "ord"), ["part", "supp"], ["ord"])


@QUERIES("g4_distinct", f"WITH {OBS} SELECT DISTINCT supp, year FROM obs")
def g4(spark, d):
    return obs(spark, d).select("supp", "year").distinct()


@QUERIES("g5_labelled_groups", f"WITH {CONTRIBUTIONS} SELECT CASE WHEN heat < 0 THEN 'drought' ELSE 'normal' END AS phase, count(*)::BIGINT AS n, round(avg(spring), 6) AS mean FROM contrib GROUP BY 1")
def g5(spark, d):
    c = contributions(spark, d)
    both = tagged_union({"drought": c.where("heat < 0"), "normal": c.where("heat >= 0")}, "phase")
    return both.groupBy("phase").agg(F.count("*").alias("n"), r6(F.avg("spring")).alias("mean"))


@QUERIES("g6_sorted_by_year", f"WITH {OBS} SELECT 'file_' || year || '.nc' AS name, count(*)::BIGINT AS n FROM obs GROUP BY 1")
def g6(spark, d):
    names = obs(spark, d).groupBy(F.concat(F.lit("file_"), F.col("year").cast("string"), F.lit(".nc")).alias("name")).agg(F.count("*").alias("n"))
    return names.orderBy(F.regexp_extract("name", r"(\d{4})", 1).cast("int"))


@QUERIES("g7_hashed_sample", f"WITH {OBS} SELECT ord, line, part, value FROM obs ORDER BY md5(concat_ws('|', ord, line, part, 42)), ord, line, part LIMIT 10000")
def g7(spark, d):
    return hashed_sample(obs(spark, d).select("ord", "line", "part", "value"), ["ord", "line", "part"], 10_000)


_RANKED = "r AS (SELECT country, ord, line, heat, row_number() OVER (PARTITION BY country ORDER BY md5(concat_ws('|', ord, line, 42)), ord, line) AS k, count(*) OVER (PARTITION BY country) AS n FROM contrib)"


@QUERIES("g8_grouped_sample", f"WITH {CONTRIBUTIONS}, {_RANKED} SELECT country, ord, line, round(heat, 6) AS heat FROM r WHERE k <= least(n, greatest(50, floor(n * 0.07)))")
def g8(spark, d):
    return grouped_sample(contributions(spark, d).select("country", "ord", "line", r6("heat").alias("heat")), ["country"], ["ord", "line"])


@QUERIES("g9_country_split", f"WITH {CONTRIBUTIONS} SELECT country = 'NATION_3' AS held_out, count(*)::BIGINT AS n FROM contrib GROUP BY 1")
def g9(spark, d):
    return contributions(spark, d).groupBy((F.col("country") == "NATION_3").alias("held_out")).agg(F.count("*").alias("n"))
