"""Readers and writers of the tables that the operators take and give."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.schema import nan_to_null


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header; without a schema one is inferred, which reads the files twice."""
    reader = spark.read.option("header", True).option("sep", sep)
    return nan_to_null((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(paths))


def rewrite_csv(spark: SparkSession, source: str, target: str, sep: str = ";") -> None:
    """A file with another separator written as plain comma CSV."""
    spark.read.option("header", True).option("sep", sep).csv(source).write.mode("overwrite").option("header", True).csv(target)


def read_many(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Files or patterns as one table; columns are matched by name."""
    reader = spark.read.option("mergeSchema", True) if fmt == "parquet" else spark.read.option("header", True)
    return nan_to_null(reader.format(fmt).load(paths))


def with_path_fields(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns from each row's file path: name -> (pattern with one group, type); null where the path doesn't match."""
    path = F.col("_metadata.file_path")
    return df.select("*", *(F.nullif(F.regexp_extract(path, p, 1), F.lit("")).try_cast(t).alias(n) for n, (p, t) in fields.items()))


def observations(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Pixel table as the canonical long form (key, variable, value); missing values have no row."""
    return df.select(*keys, *values).unpivot(keys, values, "variable", "value").where("value is not null")


def concatenated(parts: Iterable[DataFrame], renames: dict[str, str]) -> DataFrame:
    """Climate files of several periods as one table under common names."""
    out = None
    for df in parts:
        df = df.withColumnsRenamed(renames)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with one header a file; appending adds files and leaves those there alone."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_columns(df: DataFrame, columns: list[str], table: str) -> None:
    """Bulk load of a fixed column list into a catalog table."""
    df.select(*columns).write.mode("overwrite").saveAsTable(table)


def save_jdbc(df: DataFrame, columns: list[str], url: str, table: str, batch: int = 1000, **properties: str) -> None:
    """Bulk load of a fixed column list into a database."""
    df.select(*columns).write.mode("append").option("batchsize", batch).jdbc(url, table, properties=properties)


def still_wanted(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Work whose output isn't there yet."""
    return wanted.join(present.select(*on).distinct(), on, "left_anti")


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only the partitions that df has rows of, so a job can run again after a failure."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
