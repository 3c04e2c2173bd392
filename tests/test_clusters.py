"""Seasonal means keep a task's part of the groups small."""

from pyspark.sql import functions as F

from verdancy.operators.calendar import SEASONS, seasonal_means
from verdancy.plans.panels import trend_anomaly_panels
from verdancy.session import CLUSTERS


def observed(spark):
    day = F.expr("timestamp'1998-01-01 00:00:00' + make_dt_interval(cast(id * 37 % 1500 as int))")
    return spark.range(2000).select((F.col("id") % 40).cast("int").alias("row"), (F.col("id") % 7).cast("int").alias("col"), day.alias("ts"), (F.col("id") % 11).cast("double").alias("tm"))


def test_seasons_meet_in_many_tasks(spark):
    out = seasonal_means(observed(spark), ["row", "col"], "ts", ["tm"], list(SEASONS))
    assert out.select(F.spark_partition_id()).distinct().count() > CLUSTERS // 2


def test_panels_of_cells_without_a_join(spark):
    """Anomalies against a cell's own mean are those of a join with it; a cell without a name is left out."""
    climate = observed(spark).select("row", "col", F.year("ts").alias("year"), "tm").groupBy("row", "col", "year").agg(F.avg("tm").alias("tm")).withColumn("season", F.lit("a"))
    climate = climate.unionByName(spark.createDataFrame([(None, 1, 1999, 5.0, "a")], "row int, col int, year int, tm double, season string"))
    contrib = spark.createDataFrame([(y, float(y - 1997), 3.0) for y in range(1998, 2003)], "window_start int, a double, b double")
    got = {r.panel: r for r in trend_anomaly_panels(contrib, climate, ["row", "col"], ["a", "b"], ["tm"], 1998, 2002).where("season = 'a'").collect()}
    rows = [r for r in climate.collect() if r.row is not None]
    cells = {(r.row, r.col) for r in rows}
    mean = lambda x: sum(x) / len(x)
    base = {c: mean([r.tm for r in rows if (r.row, r.col) == c]) for c in cells}
    points = []
    for start in range(1998, 2001):
        own = {c: [r.tm for r in rows if (r.row, r.col) == c and start <= r.year < start + 3] for c in cells}
        own = {c: mean(x) for c, x in own.items() if x}
        b = [base[c] for c in own]
        spread = (sum((x - mean(b)) ** 2 for x in b) / (len(b) - 1)) ** 0.5
        points.append((mean([own[c] - base[c] for c in own]) / spread, (start - 1997) / (start - 1997 + 3)))
    mx, my = (mean([p[k] for p in points]) for k in (0, 1))
    slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    assert got["tm"].n == 3 and abs(got["tm"].slope - slope) < 1e-6 * max(1, abs(slope))
