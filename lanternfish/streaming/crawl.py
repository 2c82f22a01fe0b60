"""Continuous ingest: landed responses by micro-batches, and failed fetches by host with state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanternfish.sources import tables


def responses_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(tables.RESPONSES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every landed file once, then the end: a frontier that stays empty ends the run. apply gets a batch and its number, which makes writing again harmless."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timeouts_stream(log: DataFrame, over: int = 3, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """(host, port, window, n) of hosts with more than over failures in a window; log has host, port, failed, ts. State is kept until the watermark passes."""
    return log.withWatermark("ts", late).groupBy("host", "port", F.window("ts", window).alias("window")).agg(F.count(F.when(F.col("failed"), 1)).alias("n")).where(F.col("n") > over)
