"""Streaming trace sink: credentials removed, JSON lines per day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.keys import redact


def redacted(events: DataFrame) -> DataFrame:
    return events.withColumn("payload", redact(F.col("payload"), events.schema["payload"].dataType))


def start_trace(events: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the redacted events; the file sink's log makes the output exactly-once."""
    day = F.to_date("recorded_at") if "recorded_at" in events.columns else F.to_date(F.current_timestamp())
    writer = (
        redacted(events).withColumn("day", day).writeStream.format("json").partitionBy("day")
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
