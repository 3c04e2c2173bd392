"""Values carried along an order: the nearest known value before and after each row, whatever the length of the series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, by: list[str], at: str, known: str, block: Column) -> DataFrame:
    """df with `before` and `after`: `known` of the nearest row at or before and at or after each row where it isn't null.

    A series is cut into blocks, which must follow the order of `at`. Only the ends of each block meet in a window over
    blocks; rows are scanned within their block, so no series comes together in one task.
    """
    rows = df.withColumn("_block", block)
    place = F.when(F.col(known).isNotNull(), F.col(at))
    ends = rows.groupBy(*by, "_block").agg(F.max_by(known, place).alias("_last"), F.min_by(known, place).alias("_first"))
    series = Window.partitionBy(*by)
    earlier = F.last("_last", True).over(series.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("_first", True).over(series.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1))
    borders = ends.select(*by, "_block", earlier.alias("_earlier"), later.alias("_later"))
    inside = Window.partitionBy(*by, "_block")
    down = F.last(known, True).over(inside.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    up = F.last(known, True).over(inside.orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    scanned = rows.withColumn("before", down).withColumn("after", up).join(borders, [*by, "_block"])
    return scanned.withColumn("before", F.coalesce("before", "_earlier")).withColumn("after", F.coalesce("after", "_later")).drop("_block", "_earlier", "_later")
