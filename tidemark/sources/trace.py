"""Append-only trace events with credentials removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import redact
from tidemark.plans.ordered import ScanPolicy, numbered, ordered

TRACE_SCHEMA = (
    "run_id STRING, sequence BIGINT, recorded_at TIMESTAMP, elapsed_ms BIGINT, type STRING, payload MAP<STRING,STRING>"
)


def trace_events(events: DataFrame, policy: ScanPolicy | None = None) -> DataFrame:
    """Number ``run_id, recorded_at, type, payload, event_id`` per run, add elapsed time, redact."""
    scan = numbered(ordered(events, ["run_id"], ["recorded_at", "event_id"], policy), "sequence")
    started = events.groupBy("run_id").agg(F.min("recorded_at").alias("_started"))
    elapsed = F.unix_millis("recorded_at") - F.unix_millis("_started")
    return scan.done().join(started, "run_id").select(
        "run_id",
        (F.col("sequence") + 1).alias("sequence"),
        "recorded_at",
        elapsed.alias("elapsed_ms"),
        "type",
        redact(F.col("payload"), events.schema["payload"].dataType).alias("payload"),
    )


def write_trace(events: DataFrame, path: str) -> None:
    """Append as JSON lines, one folder per day; the events of a run stand together, in order."""
    dated = events.withColumn("day", F.to_date("recorded_at"))
    dated.repartition("day", "run_id").sortWithinPartitions("day", "run_id", "sequence").write.mode("append").partitionBy("day").json(path)


def read_trace(spark, path: str) -> DataFrame:
    return spark.read.schema(TRACE_SCHEMA).json(path)
