"""Grid queries read every row of a table that is taller than the least grid."""

import datetime as dt

import pytest

from verdancy.queries import queries


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """One pixel in each block of 8 x 10 cells on 400 rows, and one observation for each pixel and year."""
    d = str(tmp_path_factory.mktemp("tall"))
    keys = [row * 50 + col for row in range(400) for col in range(50)]
    spark.createDataFrame([(k, 29, 100.0) for k in keys], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    line = "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_shipdate timestamp, l_quantity double, l_discount double, l_tax double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame([(k, 1, k, 1, dt.datetime(1998, 4, 15), 10.0, 0.1, 0.1, 1000.0, "N") for k in keys], line).write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize(
    ("name", "high"),
    [("d10_coarsened_mean", 4), ("d11_coarsened_sum", 4), ("d12_support", 4), ("d27_valid_cells", 4), ("f3_anomaly", 4), ("k1_summarize_cells", 4), ("k1_wide_summary", 4), ("k5_resummary", 8), ("k8_anomaly_maps", 2), ("k13_study_area", 4)],
)
def test_no_row_is_cut(spark, tall, name, high):
    rows = {r.row for r in queries()[name](spark, tall).select("row").distinct().collect()}
    assert rows == set(range(400 // high))
