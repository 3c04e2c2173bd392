"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdancy.operators.grid import to_raster
from verdancy.queries.frames import LANDCOVER, OBS, Queries, landcover, obs, r6, scratch, table
from verdancy.sources.tables import concatenated, observations, read_csv, read_many, rewrite_csv, save_columns, still_wanted, with_path_fields, write_csv, write_json, write_partitions

QUERIES = Queries()
_SUPPLIER = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


@QUERIES("a1_read_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def a1(spark, d):
    path = scratch(spark)
    write_csv(table(spark, d, "supplier"), path)
    return read_csv(spark, path, _SUPPLIER)


@QUERIES("a2_rewrite_csv", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def a2(spark, d):
    source, target = scratch(spark), scratch(spark)
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).option("sep", ";").csv(source)
    rewrite_csv(spark, source, target)
    return spark.read.option("header", True).csv(target)


@QUERIES("a3_read_many", "SELECT n_regionkey, count(*)::BIGINT AS n FROM nation GROUP BY n_regionkey")
def a3(spark, d):
    path = scratch(spark)
    for k in range(3):
        table(spark, d, "nation").where(F.col("n_nationkey") % 3 == k).write.parquet(f"{path}/part{k}")
    return read_many(spark, [f"{path}/part*"]).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@QUERIES("a4_path_fields", "SELECT year(o_orderdate)::INT AS year, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def a4(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    rows.write.partitionBy("y").parquet(path)
    read = spark.read.option("recursiveFileLookup", True).parquet(path)
    return with_path_fields(read, {"year": (r"/y=(\d{4})/", "int")}).groupBy("year").agg(F.count("*").alias("n"))


@QUERIES("a5_observations", f"WITH {OBS} SELECT variable, count(*)::BIGINT AS n, round(sum(v), 6) AS total FROM (UNPIVOT (SELECT row, col, value, tp, vpd FROM obs) ON value, tp, vpd INTO NAME variable VALUE v) GROUP BY variable")
def a5(spark, d):
    return observations(obs(spark, d), ["row", "col"], ["value", "tp", "vpd"]).groupBy("variable").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@QUERIES("a6_concatenated", f"WITH {OBS} SELECT year, count(*)::BIGINT AS n, count(tp)::BIGINT AS n_tp FROM (SELECT ts, year, tp FROM obs WHERE year < 1998 UNION ALL SELECT ts, year, NULL FROM obs WHERE year >= 1998) GROUP BY year")
def a6(spark, d):
    o = obs(spark, d)
    old = o.where("year < 1998").select("ts", "year", "tp")
    new = o.where("year >= 1998").select(F.col("ts").alias("valid_time"), "year")
    return concatenated([old, new], {"valid_time": "ts"}).groupBy("year").agg(F.count("ts").alias("n"), F.count("tp").alias("n_tp"))


@QUERIES("a7_csv_sink", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a7(spark, d):
    path = scratch(spark)
    for _ in range(2):
        write_csv(table(spark, d, "nation"), path)
    return read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@QUERIES("a8_append_sink", "SELECT n_nationkey, count(*)::BIGINT AS n FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation) GROUP BY 1")
def a8(spark, d):
    path = scratch(spark)
    for _ in range(2):
        write_csv(table(spark, d, "nation"), path, append=True)
    return read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int").groupBy("n_nationkey").agg(F.count("*").alias("n"))


_BLOCKS = "SELECT (row // 10)::INT AS block, min(row)::INT AS first_row, max(row)::INT AS last_row FROM landcover GROUP BY 1"


@QUERIES("a9_json_sink", f"WITH {LANDCOVER} {_BLOCKS}")
def a9(spark, d):
    path = scratch(spark)
    blocks = landcover(spark, d).groupBy(F.floor(F.col("row") / 10).cast("int").alias("block"))
    write_json(blocks.agg(F.min("row").alias("first_row"), F.max("row").alias("last_row")), path)
    return spark.read.schema("block int, first_row int, last_row int").json(path)


@QUERIES("a10_table_sink", "SELECT s_suppkey, s_nationkey FROM supplier")
def a10(spark, d):
    name = f"verdancy_{scratch(spark).rsplit('/', 1)[1]}"
    save_columns(table(spark, d, "supplier"), ["s_suppkey", "s_nationkey"], name)
    return spark.table(name)


@QUERIES("a11_still_wanted", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def a11(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return still_wanted(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@QUERIES("a11_partition_overwrite", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def a11b(spark, d):
    path, o = scratch(spark), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    write_partitions(o, path, ["o_orderstatus"])
    write_partitions(o.where("o_orderstatus = 'F'"), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@QUERIES(
    "a12_raster_sink",
    f"""WITH {LANDCOVER}, size AS (SELECT max(row) + 1 AS h FROM landcover), cells AS (SELECT row, col, elev FROM landcover WHERE cls > 10)
SELECT r::INT AS row, c::INT AS col, coalesce(elev, -9999.0)::DOUBLE AS elev FROM (SELECT unnest(range(0, h)) AS r FROM size) CROSS JOIN (SELECT unnest(range(0, 50)) AS c) LEFT JOIN cells ON r = row AND c = col""",
)
def a12(spark, d):
    cells = landcover(spark, d)
    height = cells.agg(F.max("row")).first()[0] + 1
    return to_raster(cells.where("cls > 10"), "elev", height, 50, -9999.0)
