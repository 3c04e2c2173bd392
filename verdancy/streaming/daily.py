"""Daily degree-day and chilling values kept up to date from a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdancy.sources.tables import write_partitions


def daily_values(readings: DataFrame, keys: list[str], ts: str, t: str, base: float = 5.0, late: str = "2 days") -> DataFrame:
    """Per key and day: growing-degree value and chilling flag. On a stream, days stay open for readings up to `late` behind."""
    day = F.window(F.col(ts), "1 day").alias("w")
    rows = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    daily = rows.groupBy(*keys, day).agg(F.max(t).alias("hi"), F.min(t).alias("lo"), F.avg(t).alias("mean"))
    gdd = F.greatest(F.coalesce((F.col("hi") + F.col("lo")) / 2 - base, F.lit(0.0)), F.lit(0.0))
    chilling = F.when(F.col("mean") < base, 1).when(F.col("mean") >= base, 0)
    return daily.select(*keys, F.to_date("w.start").alias("day"), gdd.alias("gdd"), chilling.alias("chilling"))


def keep_daily(readings: DataFrame, keys: list[str], ts: str, t: str, target: str, checkpoint: str, base: float = 5.0, late: str = "2 days"):
    """Runs over what has arrived so far and replaces the changed days under `target`, a table partitioned by day.

    A batch holds only days that changed; their rows are merged with those there, so a batch may be repeated.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        changed = held = batch.persist()
        days = changed.select("day").distinct()
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.parquet(target).select(changed.columns).join(F.broadcast(days), "day", "left_semi").join(changed.select(*keys, "day"), [*keys, "day"], "left_anti")
            changed = changed.unionByName(old).checkpoint()
        write_partitions(changed, target, ["day"])
        held.unpersist()

    sc = readings.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        sc.setCheckpointDir(f"{checkpoint}/cut")
    values = daily_values(readings, keys, ts, t, base, late)
    return values.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
