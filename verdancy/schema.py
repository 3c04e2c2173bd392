"""Canonical tables and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_YEAR = (
    "gridid string, year int, row int, col int, weights double, country string, target double, "
    "tp_spring double, tp_summer double, tp_autumn double, tp_winter double, vpd double, tm double, spei double"
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column: avg then skips what is missing. Called once where data come in."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
