"""Column expressions of single rows; all stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scaled(raw: ColumnLike, scale: float = 1e-4, fill: int = -3000) -> Column:
    """Raw integer times its scale; the fill value is compared before scaling and becomes null."""
    return F.when(_c(raw) != fill, _c(raw) * scale)


def without_nodata(value: ColumnLike, *nodata: float) -> Column:
    return F.when(~_c(value).isin(*nodata), _c(value))


def kelvin_to_celsius(t: ColumnLike) -> Column:
    return _c(t) - 273.15


def metres_to_millimetres(x: ColumnLike) -> Column:
    return _c(x) * 1000


def epoch_day_of_year(days: ColumnLike) -> Column:
    """Day of the year of a number of days since 1970-01-01."""
    return F.dayofyear(F.date_from_unix_date(_c(days).cast("int")))


def parsed_timestamp(text: ColumnLike, *formats: str) -> Column:
    """The first of the formats that reads the text; null where none does."""
    return F.coalesce(*(F.try_to_timestamp(_c(text), F.lit(f)) for f in formats))


def midpoint(start: ColumnLike, end: ColumnLike) -> Column:
    """The timestamp half way, to the second."""
    return F.timestamp_seconds(F.floor((F.unix_timestamp(_c(start).cast("timestamp")) + F.unix_timestamp(_c(end).cast("timestamp"))) / 2))


def record_years(start: ColumnLike, end: ColumnLike) -> Column:
    """Length of a record in years of 365 days, half years to the even number."""
    return F.bround(F.datediff(_c(end), _c(start)) / 365).cast("int")


def cell_key(*parts: ColumnLike) -> Column:
    return F.concat_ws("_", *(_c(p).cast("string") for p in parts))


def _saturation(t: Column, kelvin_base: Column, z: Column) -> Column:
    pressure = 1013.25 * F.pow(kelvin_base / (kelvin_base + 0.0065 * z), F.lit(5.625))
    return 6.112 * (1 + 7e-4 + 3.46e-6 * pressure) * F.exp(17.67 * t / (t + 243.5))


def vapour_pressure_deficit(t: ColumnLike, dew: ColumnLike, z: ColumnLike) -> Column:
    """hPa from air temperature, dew point (both Celsius) and elevation (m)."""
    base = 273.16 + _c(t)
    return _saturation(_c(t), base, _c(z)) - _saturation(_c(dew), base, _c(z))


def row_mean(*cols: ColumnLike) -> Column:
    """Mean over columns, nulls left out; null if all are."""
    total = reduce(lambda a, b: a + b, (F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols))
    n = reduce(lambda a, b: a + b, (_c(c).isNotNull().cast("int") for c in cols))
    return F.when(n > 0, total / n)


def absolute_total(*cols: ColumnLike) -> Column:
    return reduce(lambda a, b: a + b, (F.abs(_c(c)) for c in cols))


def signed_share(value: ColumnLike, *among: ColumnLike) -> Column:
    """value over the sum of absolute values; null where that is zero."""
    return F.try_divide(_c(value), absolute_total(*among))


def absolute_share(value: ColumnLike, *among: ColumnLike) -> Column:
    return F.try_divide(F.abs(_c(value)), absolute_total(*among))


def drought_lag(spei: ColumnLike, year: ColumnLike, drought_year: int) -> Column:
    return _c(spei) * (_c(year) - drought_year)


def min_max(value: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    return F.try_divide(_c(value) - _c(low), _c(high) - _c(low))


def equation_label(slope: ColumnLike, intercept: ColumnLike) -> Column:
    sign = F.when(_c(intercept) < 0, "-").otherwise("+")
    return F.format_string("y = %.3fx %s %.3f", _c(slope), sign, F.abs(_c(intercept)))


def window_label(start: ColumnLike, end: ColumnLike) -> Column:
    return F.concat(_c(start).cast("string"), F.lit("-"), _c(end).cast("string"))


def pixel_index(x: ColumnLike, origin: float, step: float) -> Column:
    """Row or column of a coordinate on a regular axis."""
    return F.floor((_c(x) - origin) / step).cast("int")


def cell_centre(index: ColumnLike, origin: float, step: float) -> Column:
    return origin + (_c(index) + 0.5) * step


def region_number(text: ColumnLike) -> Column:
    """The first figure run of a free text such as `R3` or `3-Alpine`; 0 where there is none."""
    return F.coalesce(F.regexp_extract(_c(text), r"(\d+)", 1).try_cast("int"), F.lit(0))


def without_plot_suffix(country: ColumnLike) -> Column:
    return F.regexp_replace(_c(country), r"_plot_\d+", "")


def drought_phase(target: ColumnLike, *others: ColumnLike) -> Column:
    """`drought` where the target season's index is below 0 and the others' aren't, `normal` where none is, else null."""
    wet = reduce(lambda a, b: a & b, (_c(o) >= 0 for o in others), F.lit(True))
    return F.when((_c(target) < 0) & wet, "drought").when((_c(target) >= 0) & wet, "normal")
