"""Opcode frequencies over a stream of events, by windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_frequency(events: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """start, opcode, count. On a stream, windows close once the watermark passes them; state is one row for each open window and opcode."""
    timed = events.withWatermark("ts", lateness) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("opcode")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "opcode", "count")


def run_once(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> DataFrame:
    """Read what is in folder as a stream, write closed windows to out, and return them. A restart goes on from the checkpoint."""
    stream = windowed_frequency(spark.readStream.schema(schema).parquet(folder))
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)
