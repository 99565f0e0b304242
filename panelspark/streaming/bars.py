"""Event bars as a Structured Streaming aggregation; the same plan runs over a batch table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_event_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """``symbol, date, n, low, high, total`` of each event type and day; on a stream, rows later than ``late`` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    bars = rows.groupBy(F.window("ts", "1 day"), F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.sum("value"), 4).alias("total"))
    return bars.select("symbol", F.col("window.start").cast("date").alias("date"), "n", "low", "high", "total")


def streamed_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the files of ``events`` to the end and returns the bars. The result's size is days by event types."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"event_bars_{uuid.uuid4().hex}"
    query = daily_event_bars(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


EVENT_BARS_SQL = "SELECT event_type AS symbol, CAST(ts AS DATE) AS date, count(*) AS n, min(value) AS low, max(value) AS high, round(sum(value), 4) AS total FROM events GROUP BY ALL"
