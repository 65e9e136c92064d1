"""Edge streams: incremental degrees and windowed counts with watermarks; late rows are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a file stream."""
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; works on streams and tables alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    x = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def degree_stream(edges: DataFrame) -> DataFrame:
    """(id, degree) updated with each micro-batch of edges(src, dst)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what is there into an in-memory table, then stop."""
    df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
