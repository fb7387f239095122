"""The stage ledger as a stream. Streaming is an extension of this engine; all state is bounded by watermarks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def typed(events: DataFrame) -> DataFrame:
    """Events with a time that watermarks accept."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, size: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """Counts and sums (in hundredths) by tumbling window and type; repeated event ids count once within the watermark."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"))


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of sessions that a gap ends."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


def read_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", per_trigger: int = 16) -> DataFrame:
    """Ledger files of a folder, a bounded number each trigger."""
    s = spark.readStream.schema(StructType.fromDDL(EVENTS)).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger)
    return typed(s.parquet(folder))


def replay_windows(spark: SparkSession, path: str, size: str = "1 day") -> DataFrame:
    """All of a ledger table run as a stream into daily counts; complete mode, so windows that are still open count too."""
    folder, _, name = path.rpartition("/")
    stream = typed(spark.readStream.schema(StructType.fromDDL(EVENTS)).option("pathGlobFilter", name).parquet(folder))
    counts = stream.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents"))
    sink = f"leafspark_{uuid.uuid4().hex}"
    # The sink holds a row for each day and type: its size doesn't grow with the events of a day.
    job = counts.writeStream.outputMode("complete").format("memory").queryName(sink).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.table(sink).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "cents")
