"""Streams of snapshot files and of edges. State stays bounded by a watermark or by the files themselves.

The reference keeps no state between calls; these are its batch operators fed
by Structured Streaming: line counts a window, and findings as files arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, ext string, tracked boolean, content string, error string"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """files rows of JSON batches that land in a folder."""
    return spark.readStream.schema(FILES).json(folder)


def counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, kind, n: events a tumbling window; later ones than the watermark are dropped."""
    windowed = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("window_start"), kind, "n")


def each_batch(stream: DataFrame, report, sink: str, checkpoint: str):
    """Runs report(files) on every batch and appends what it finds; a batch that runs again writes its own folder again."""
    def put(batch: DataFrame, number: int) -> None:
        report(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
