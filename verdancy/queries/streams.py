"""Streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.queries.frames import Queries, r6, scratch, table
from verdancy.queries.summaries import _HOURLY
from verdancy.streaming.daily import keep_daily

QUERIES = Queries()


@QUERIES("s1_streamed_degree_days", f"WITH {_HOURLY} SELECT user_id, ts::DATE AS day, round(greatest(coalesce((max(t) + min(t)) / 2 - 5, 0), 0), 6) AS gdd, CASE WHEN avg(t) < 5 THEN 1 WHEN avg(t) >= 5 THEN 0 END AS chilling FROM h GROUP BY 1, 2")
def s1(spark, d):
    events = table(spark, d, "events")
    folder = scratch(spark)
    source, target, state = f"{folder}/in", f"{folder}/days", f"{folder}/state"
    events.select("user_id", "ts", "event_type", "value").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    readings = stream.select("user_id", "ts", F.when(F.col("event_type") != "error", F.col("value") - 45).alias("t"))
    keep_daily(readings, ["user_id"], "ts", "t", target, state).awaitTermination()
    return spark.read.parquet(target).select("user_id", "day", r6("gdd").alias("gdd"), "chilling")
