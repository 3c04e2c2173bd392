"""The given tables in the roles of observations, stations and cells, and the same as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.session import shared_folder


class Queries:
    def __init__(self):
        self.found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def register(f):
            self.found[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the one that spark.checkpoint.dir names."""
    return f"{shared_folder(spark)}/queries/{uuid.uuid4().hex}"


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def r6_ties(x: Column | str) -> Column:
    """As r6, for means of exact decimals: what lies on the edge of the sixth place goes up, whatever the last bit of the sum."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-10, 6)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels are parts on a grid of 50 columns, observed on the days they were shipped."""
    part = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(part / 50).cast("int").alias("row"), (part % 50).cast("int").alias("col"), part.alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("ts"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        F.col("l_quantity").alias("value"), F.col("l_discount").alias("tp"), F.col("l_tax").alias("vpd"), F.col("l_extendedprice").alias("tm"), F.col("l_returnflag").alias("flag"),
    )


OBS = """obs AS (SELECT (l_partkey // 50)::INT AS row, (l_partkey % 50)::INT AS col, l_partkey AS part, l_suppkey AS supp, l_orderkey AS ord, l_linenumber AS line,
  l_shipdate AS ts, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, l_quantity AS value, l_discount AS tp, l_tax AS vpd, l_extendedprice AS tm, l_returnflag AS flag FROM lineitem)"""


def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the region of their supplier."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"), F.col("n_regionkey").alias("region"))
    return obs(spark, sf_dir).join(s, "supp").join(n, "n_nationkey")


REGIONAL = OBS + """, regional AS (SELECT obs.*, n_nationkey, n_name AS country, n_regionkey AS region FROM obs JOIN supplier ON supp = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each pixel and year."""
    return obs(spark, sf_dir).groupBy("row", "col", "year").agg(*(F.avg(c).alias(c) for c in ("value", "tp", "vpd", "tm")))


YEARLY = OBS + """, yearly AS (SELECT row, col, year, avg(value) AS value, avg(tp) AS tp, avg(vpd) AS vpd, avg(tm) AS tm FROM obs GROUP BY ALL)"""


def landcover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class, an elevation and a region number for each pixel."""
    part = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.floor(part / 50).cast("int").alias("row"), (part % 50).cast("int").alias("col"), (F.col("p_size") % 30).cast("int").alias("cls"), F.col("p_retailprice").alias("elev"), (F.col("p_size") % 15 + 1).cast("int").alias("region_id")
    )


LANDCOVER = """landcover AS (SELECT (p_partkey // 50)::INT AS row, (p_partkey % 50)::INT AS col, (p_size % 30)::INT AS cls, p_retailprice AS elev, (p_size % 15 + 1)::INT AS region_id FROM part)"""


ROWS, COLS = 42, 50  # the least grid; its rows grow with the table


def grid_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Rows and columns of the grid that holds every pixel of the table."""
    last = landcover(spark, sf_dir).agg(F.max("row")).first()[0]
    return max(ROWS, 0 if last is None else last + 1), COLS


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed columns in the role of contributions of seasons and climate."""
    return regional(spark, sf_dir).select(
        "row", "col", "country", "region", "year", "ord", "line", "value",
        (F.col("value") - 25).alias("spring"), ((F.col("tp") - 0.05) * 500).alias("summer"), ((F.col("vpd") - 0.04) * 500).alias("autumn"), ((F.col("line") - 4) * 5.0).alias("winter"), (F.col("tm") / 1000 - 40).alias("heat"),
    )


CONTRIBUTIONS = REGIONAL + """, contrib AS (SELECT row, col, country, region, year, ord, line, value, value - 25 AS spring, (tp - 0.05) * 500 AS summer, (vpd - 0.04) * 500 AS autumn, (line - 4) * 5.0::DOUBLE AS winter, tm / 1000 - 40 AS heat FROM regional)"""
