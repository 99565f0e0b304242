"""Bars, context, external factors and pick lists in files, and tables and reports written back.

Paths are whatever Spark's readers open. Keys are checked as they are read: a date that is no date, a symbol that is none or
a repeated key is an error, because later joins would multiply or lose rows without a word.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.columns import date_of, number_of, stable_json, symbol_of

#: Columns of a research context that are numbers, and those that are text or flags.
CONTEXT_NUMBERS = ("open", "high", "low", "close", "volume", "amount", "up_limit", "down_limit", "turnover_value", "daily_return", "market_cap", "circulating_market_cap", "total_mv", "cap", "turnover_rate", "volume_ratio", "pb", "book_to_market", "listing_age_days")
CONTEXT_LABELS = ("sector", "industry", "subindustry", "regime", "is_st", "is_suspended", "suspend_type", "board", "name")


def unique_keys(df: DataFrame, *keys: str) -> DataFrame:
    """``df``; an error if a key is null or stands twice. One aggregation over the keys."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(" or ".join([*(f"`{k}` is null" for k in keys), "n > 1"])).limit(1).collect()
    if bad:
        raise ValueError(f"invalid or repeated key: {bad[0].asDict()}")
    return df


def _csv(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    names = [c.strip().lower() for c in out.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns of equal names: {names}")
    return out.toDF(*names)


def _need(df: DataFrame, *columns: str) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_bars(spark: SparkSession, folder: str, symbols: Iterable[str] | None = None, end: str | None = None) -> DataFrame:
    """``symbol, date`` and the other columns of a folder with one CSV for each symbol, named after it; ``symbols`` reads only
    their files, ``end`` keeps dates up to it. Rows without a valid date go; of a date that stands twice in a file the last row
    stays. Columns other than date that are wholly numbers in the price and volume sense are cast, others stay text."""
    raw = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
    file = symbol_of(F.regexp_replace(F.col("_metadata.file_name"), r"\.[cC][sS][vV]$", ""))
    if symbols is not None:
        wanted = sorted({s.split(".")[0].zfill(6) for s in symbols})
        raw = raw.where(file.isin(wanted)) if wanted else raw.limit(0)
    names = {c: c.strip().lower() for c in raw.columns}
    if "date" not in names.values():
        raise ValueError("missing columns: date")
    numbers = set(CONTEXT_NUMBERS)
    rows = raw.select(file.alias("symbol"), *((date_of(c) if n == "date" else number_of(f"`{c}`") if n in numbers else F.col(f"`{c}`")).alias(n) for c, n in names.items() if n != "symbol"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.where("date is not null")
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    rest = [c for c in rows.columns if c not in ("symbol", "date", "__at", "__row")]
    last = rows.groupBy("symbol", "date").agg(F.max(F.struct("__at", "__row", *rest)).alias("r"))
    return last.select("symbol", "date", *(F.col(f"r.{c}").alias(c) for c in rest))


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """Point-in-time context by ``date, symbol`` from one CSV or a folder of dated CSVs; a folder whose manifest isn't complete is
    an error. market_cap is taken from total_mv or cap where it is no column of its own."""
    manifest = _file_text(spark, f"{path.rstrip('/')}/_context_manifest.json")
    if manifest is not None and json.loads(manifest).get("status") != "complete":
        raise ValueError("the context is partial: its manifest isn't complete")
    df = _csv(spark, path)
    _need(df, "date", "symbol")
    numbers, labels = ([c for c in kind if c in df.columns] for kind in (CONTEXT_NUMBERS, CONTEXT_LABELS))
    if not numbers and not labels:
        raise ValueError("no supported context columns")
    out = df.select(date_of("date").alias("date"), symbol_of("symbol").alias("symbol"), *(number_of(c).alias(c) for c in numbers), *labels)
    if "market_cap" not in numbers:
        for alias in ("total_mv", "cap"):
            if alias in numbers:
                out = out.withColumn("market_cap", F.col(alias))
                break
    return unique_keys(out, "date", "symbol")


def read_factors(spark: SparkSession, path: str, factors: Iterable[str] | None = None, layout: str = "auto", name: str = "factor", value: str = "factor_value") -> DataFrame:
    """``date, symbol`` and a column for each factor of a CSV that is wide (a column a factor) or long (a row a value)."""
    if layout not in ("auto", "wide", "long"):
        raise ValueError("layout must be auto, wide or long")
    df = _csv(spark, path)
    _need(df, "date", "symbol")
    wanted = None if factors is None else list(dict.fromkeys(f.strip().lower() for f in factors))
    keyed = df.withColumns({"date": date_of("date"), "symbol": symbol_of("symbol")})
    if layout == "long" or layout == "auto" and {name, value} <= set(df.columns):
        _need(df, name, value)
        keyed = keyed.select("date", "symbol", F.lower(F.trim(name)).alias("f"), number_of(value).alias("v"))
        unique_keys(keyed, "date", "symbol", "f")
        # a pivot's columns are its factors, named or listed: few
        columns = wanted or sorted(r["f"] for r in keyed.select("f").distinct().collect())
        return keyed.groupBy("date", "symbol").agg(*(F.max(F.when(F.col("f") == c, F.col("v"))).alias(c) for c in columns))
    columns = wanted or [c for c in df.columns if c not in ("date", "symbol")]
    _need(df, *columns)
    return unique_keys(keyed.select("date", "symbol", *(number_of(c).alias(c) for c in columns)), "date", "symbol")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _file_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON file with sorted keys, whole or not at all."""
    fs, p = _file_system(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    stream.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1).encode()))
    stream.close()
    fs.delete(p, False)
    fs.rename(part, p)


def save_candidates(spark: SparkSession, folder: str, pick_date: str, candidates: list[dict], meta: dict | None = None, latest: bool = True) -> None:
    """The picks of a date under its own name and, with ``latest``, as the newest."""
    run = {"pick_date": pick_date, "candidates": candidates, "meta": meta or {}}
    for name in (pick_date, "latest") if latest else (pick_date,):
        write_json(spark, f"{folder.rstrip('/')}/candidates_{name}.json", run)


def load_candidates(spark: SparkSession, folder: str, pick_date: str = "latest") -> dict:
    text = _file_text(spark, f"{folder.rstrip('/')}/candidates_{pick_date}.json")
    if text is None:
        raise FileNotFoundError(f"no candidates of {pick_date}")
    return json.loads(text)


def write_table(df: DataFrame, path: str, form: str = "csv", files: int | None = 1) -> None:
    """A table as a folder of CSV or Parquet, put in place of an older one only when whole. Structs and maps become JSON in CSV;
    ``files`` None leaves as many as there are partitions."""
    if form == "csv":
        df = df.select(*((stable_json(f"`{f.name}`", f.dataType).alias(f.name) if isinstance(f.dataType, (T.MapType, T.StructType)) else F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`")) for f in df.schema))
    spark, part = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    (df.coalesce(files) if files else df).write.format(form).options(**({"header": True, "escape": '"'} if form == "csv" else {})).save(part)
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(part), p)


def write_reports(tables: Mapping[str, DataFrame], folder: str, form: str = "csv") -> None:
    """Each table under its name, and ``reports.json`` with the names and columns written."""
    for name, df in tables.items():
        write_table(df, f"{folder.rstrip('/')}/{name}", form)
    if tables:
        spark = next(iter(tables.values())).sparkSession
        write_json(spark, f"{folder.rstrip('/')}/reports.json", {name: df.columns for name, df in tables.items()})
