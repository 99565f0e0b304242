"""Bars and dense panels from a table of trades (``lineitem`` with ``part``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, date`` (week begin), open, high, low, close, volume, amount, vwap of each brand."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    trades = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    rows = trades.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("symbol", F.lpad(F.replace("p_brand", F.lit("Brand#"), F.lit("")), 6, "0")).withColumn("date", F.date_trunc("week", "l_shipdate").cast("date"))
    bars = rows.groupBy("symbol", "date").agg(
        F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, order).alias("close"),
        F.round(F.sum("l_quantity"), 2).alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )
    return bars.withColumn("vwap", F.col("amount") / F.col("volume"))


def densify(bars: DataFrame) -> DataFrame:
    """Every symbol on every date: rows without a bar hold nulls. The grid is the result's own size."""
    dates, symbols = bars.select("date").distinct(), bars.select("symbol").distinct()
    return symbols.crossJoin(F.broadcast(dates)).join(bars, ["symbol", "date"], "left")


def research_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense weekly panel with returns, a capitalisation proxy, groups and the benchmark's series."""
    w = Window.partitionBy("symbol").orderBy("date")
    p = densify(weekly_bars(spark, sf_dir))
    p = p.withColumn("returns", F.col("close") / F.lag("close").over(w) - 1).withColumn("cap", F.col("close") * F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("sector", F.substring("symbol", 5, 1)).withColumn("industry", F.substring("symbol", 6, 1)).withColumn("subindustry", F.substring("symbol", 5, 1))
    bench = p.groupBy("date").agg((F.round(F.sum(F.col("open") * F.col("amount")), 2) / F.sum("amount")).alias("bench_open"), (F.round(F.sum(F.col("close") * F.col("amount")), 2) / F.sum("amount")).alias("bench_close"), F.round(F.avg("returns"), 10).alias("mkt"), F.round(F.avg(F.when(F.col("sector") <= "2", F.col("returns"))) - F.avg(F.when(F.col("sector") > "2", F.col("returns"))), 10).alias("smb"), F.round(F.avg(F.when(F.col("industry") <= "2", F.col("returns"))) - F.avg(F.when(F.col("industry") > "2", F.col("returns"))), 10).alias("hml"))
    return p.join(bench, "date")


BARS_SQL = """
SELECT lpad(replace(p_brand, 'Brand#', ''), 6, '0') AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
       arg_min(l_extendedprice / l_quantity, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_partkey, e := l_extendedprice)) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       arg_max(l_extendedprice / l_quantity, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_partkey, e := l_extendedprice)) AS close,
       round(sum(l_quantity), 2) AS volume, round(sum(l_extendedprice), 2) AS amount,
       round(sum(l_extendedprice), 2) / round(sum(l_quantity), 2) AS vwap
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""

PANEL_SQL = f"""
WITH bars AS ({BARS_SQL}),
grid AS (SELECT s.symbol, d.date, b.* EXCLUDE (symbol, date) FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = d.date),
more AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS returns,
         close * sum(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cap,
         substr(symbol, 5, 1) AS sector, substr(symbol, 6, 1) AS industry, substr(symbol, 5, 1) AS subindustry FROM grid),
bench AS (SELECT date, round(sum(open * amount), 2) / sum(amount) AS bench_open, round(sum(close * amount), 2) / sum(amount) AS bench_close, round(avg(returns), 10) AS mkt,
          round(avg(CASE WHEN sector <= '2' THEN returns END) - avg(CASE WHEN sector > '2' THEN returns END), 10) AS smb,
          round(avg(CASE WHEN industry <= '2' THEN returns END) - avg(CASE WHEN industry > '2' THEN returns END), 10) AS hml FROM more GROUP BY date)
SELECT more.*, bench.* EXCLUDE (date) FROM more JOIN bench USING (date)"""
