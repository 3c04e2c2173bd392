import datetime as dt

from verdancy.streaming.daily import keep_daily

SCHEMA = "k int, ts timestamp, t double"


def test_days_follow_late_readings(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "days", "state"))

    def arrive(*rows):
        spark.createDataFrame([(k, dt.datetime(2024, 1, d, h), t) for k, d, h, t in rows], SCHEMA).write.mode("append").parquet(source)
        keep_daily(spark.readStream.schema(SCHEMA).parquet(source), ["k"], "ts", "t", target, state).awaitTermination()
        return {(r.k, r.day.day): (r.gdd, r.chilling) for r in spark.read.parquet(target).collect()}

    assert arrive((1, 1, 3, 4.0), (1, 1, 14, 14.0), (2, 1, 5, 4.0)) == {(1, 1): (4.0, 0), (2, 1): (0.0, 1)}
    assert arrive((1, 1, 20, 24.0), (1, 2, 1, None)) == {(1, 1): (9.0, 0), (2, 1): (0.0, 1), (1, 2): (0.0, None)}
