"""Micro-batch forms of the summaries: windowed totals of an event stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_summary(events: DataFrame, ts: str, cls: Sequence[str], sums: dict[str, str], size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and class, for streams and tables alike; on a
    stream, rows later than `late` are dropped and closed windows are released."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    out = source.groupBy(F.window(ts, size).alias("w"), *cls).agg(F.count("*").alias("n"), *[F.sum(v).alias(name) for v, name in sums.items()])
    return out.select(F.col("w.start").alias("window_start"), *cls, "n", *sums.values())


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends closed windows to a Parquet folder exactly once, and stops at the end of what is there."""
    return stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
