"""Tickets per ride over a stream of ticket files (Structured Streaming).

The same aggregation as the batch ``ride_counts``, made incremental: the
ticket files of a folder are read as they arrive, counted per ride key, and a
ride's count is final once the watermark on its travel date has passed, so the
state store holds only the rides still open (not every ride ever seen).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ride_counts_stream(spark: SparkSession, source: str, schema: StructType | str, keys: list[str],
                       event_time: str, delay: str = "2 days", name: str = "number_of_tickets",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming frame of final ticket counts per ride (append mode).

    ``event_time`` must be one of ``keys`` (a timestamp): grouping on it lets
    the watermark retire a ride's state once its date is ``delay`` behind the
    newest ticket seen."""
    if event_time not in keys:
        raise ValueError("event_time must be a group key")
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    tickets = r.parquet(source)
    tickets = tickets.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return (tickets.dropna(subset=list(keys))
            .withWatermark(event_time, delay)
            .groupBy(*keys).agg(F.count(F.lit(1)).alias(name)))


def start_ride_counts(counts: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                      trigger_once: bool = False, query_name: str | None = None) -> StreamingQuery:
    """Append final counts to ``sink`` (files, or an in-memory table with
    ``fmt='memory'`` in tests); ``checkpoint`` must be on the shared file system
    so a restarted query resumes exactly once."""
    w = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if fmt == "memory":
        w = w.format("memory").queryName(query_name or "ride_counts")
    else:
        w = w.format(fmt).option("path", sink)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
