"""Column expressions: keys and numbers read from text, stable JSON, percentile ranks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss")


def symbol_of(c: Column | str) -> Column:
    """A symbol's code: what stands before a dot, digits filled up to six; null for an empty one."""
    text = F.trim(F.split_part((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("."), F.lit(1)))
    return F.when(F.length(text) > 0, F.when(text.rlike("^[0-9]{1,5}$"), F.lpad(text, 6, "0")).otherwise(text))


def date_of(c: Column | str) -> Column:
    """A date from text in any of DATE_FORMATS; null for what is none."""
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS)).cast("date")


def number_of(c: Column | str) -> Column:
    """A finite number; null for text that is none."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def stable_json(c: Column | str, kind: T.DataType) -> Column:
    """A struct or map as JSON with its keys in order; null as an empty object."""
    x = F.col(c) if isinstance(c, str) else c
    if isinstance(kind, T.MapType):
        x = F.map_from_entries(F.array_sort(F.map_entries(x)))
    elif isinstance(kind, T.StructType):
        x = F.when(x.isNotNull(), F.struct(*(x[n].alias(n) for n in sorted(kind.names))))
    return F.coalesce(F.to_json(x), F.lit("{}"))


def percentile_rank(value: str, *by: str, ascending: bool = True) -> Column:
    """Percentile rank with average ties among the non-null values of a group."""
    v = F.col(value)
    lower = F.rank().over(Window.partitionBy(*by, v.isNull()).orderBy(v if ascending else v.desc()))
    ties, n = F.count(F.lit(1)).over(Window.partitionBy(*by, v)), F.count(v).over(Window.partitionBy(*by))
    return F.when(v.isNotNull(), (lower + (ties - 1) / F.lit(2.0)) / n)
