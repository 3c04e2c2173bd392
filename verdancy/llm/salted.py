"""Aggregates of a key beside its rows, where one key may hold a large share of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64
SALT_ROWS = 100_000


def with_smallest(rows: DataFrame, key: str, value: str, into: str, n_rows: int, more: DataFrame | None = None) -> DataFrame:
    """rows with the smallest `value` of their `key` in column `into`; rows without a key or a value have no part in it and none beside them.

    Rows meet their key's result by key and salt, one salt for each SALT_ROWS of n_rows rows, so that the rows of a
    frequent key are many small groups; the results are brought to the salts first, and with them the columns of `more`,
    which has a row for each value of `into` at most.
    """
    salts = max(SALTS, n_rows // SALT_ROWS)

    def salt(of: str) -> Column:
        return F.pmod(F.xxhash64(F.col(of)), F.lit(salts)).cast("int")

    salted = rows.withColumn("salt", salt(value))
    own = salted.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, "salt").agg(F.min(value).alias("own"))
    least = own.groupBy(key).agg(F.min("own").alias(into))
    if more is not None:
        least = least.join(more, into, "left")
    dealt = own.select(key, "salt").join(least, key)
    return salted.join(dealt, [key, "salt"], "left").drop("salt")


def beside(rows: DataFrame, key: str, spread: str, table: DataFrame, n_rows: int) -> DataFrame:
    """rows with the columns of `table`, which has one row per key at most, or nulls.

    Rows meet the table by key and salt, the salt a hash of column `spread`; the table's rows are brought to the salts
    first, so that the rows of a frequent key are many small groups.
    """
    salts = max(SALTS, n_rows // SALT_ROWS)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    dealt = salted.where(F.col(key).isNotNull()).select(key, "salt").distinct().join(table, key)
    return salted.join(dealt, [key, "salt"], "left").drop("salt")
