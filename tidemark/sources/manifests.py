"""Manifest tables: declared schemas, JSON interchange, Parquet storage, integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One table per manifest family, all videos together, ``ord`` = position in the manifest.
SCHEMAS = {
    "shots": "video_id STRING, ord BIGINT, shot_id STRING, start_ms BIGINT, end_ms BIGINT, confidence DOUBLE",
    "transcript_segments": (
        "video_id STRING, ord BIGINT, segment_id STRING, start_ms BIGINT, end_ms BIGINT, raw_text STRING, "
        "normalized_text STRING, source STRING, language STRING, confidence DOUBLE, "
        "words ARRAY<STRUCT<text: STRING, start_ms: BIGINT, end_ms: BIGINT, confidence: DOUBLE>>, source_stream_index INT"
    ),
    "chunks": (
        "video_id STRING, ord BIGINT, chunk_id STRING, start_ms BIGINT, end_ms BIGINT, shot_ids ARRAY<STRING>, "
        "segment_ids ARRAY<STRING>, insp_start_ms BIGINT, insp_end_ms BIGINT, text STRING, basis STRING"
    ),
    "frames": (
        "video_id STRING, ord BIGINT, frame_id STRING, timestamp_ms BIGINT, requested_timestamp_ms BIGINT, "
        "image_uri STRING, segment_ids ARRAY<STRING>"
    ),
    "ocr_observations": (
        "video_id STRING, observation_id STRING, frame_id STRING, timestamp_ms BIGINT, raw_text STRING, "
        "normalized_text STRING, bbox STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>, "
        "confidence DOUBLE, language STRING"
    ),
    "ocr_spans": (
        "video_id STRING, span_id STRING, start_ms BIGINT, end_ms BIGINT, text STRING, "
        "observation_ids ARRAY<STRING>, confidence DOUBLE"
    ),
    "visual_descriptions": (
        "video_id STRING, description_id STRING, start_ms BIGINT, end_ms BIGINT, text STRING, mode STRING, "
        "frame_ids ARRAY<STRING>, tags ARRAY<STRING>, confidence DOUBLE, question STRING"
    ),
    "index_documents": (
        "video_id STRING, item_id STRING, text STRING, start_ms BIGINT, end_ms BIGINT, "
        "source_ids ARRAY<STRING>, tags ARRAY<STRING>"
    ),
    "evidence": (
        "video_id STRING, evidence_id STRING, start_ms BIGINT, end_ms BIGINT, modality STRING, "
        "source_ids ARRAY<STRING>, text STRING, scores MAP<STRING, DOUBLE>, confidence DOUBLE"
    ),
    "audio_assets": (
        "video_id STRING, audio_id STRING, uri STRING, source_start_ms BIGINT, source_end_ms BIGINT, stream_index INT"
    ),
}


def read_json(spark: SparkSession, family: str, path: str) -> DataFrame:
    """Strictly typed: a record that does not fit the schema fails the read."""
    return spark.read.schema(SCHEMAS[family]).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str, files_per_write: int | None = None) -> None:
    """Parquet, rows of a video next to each other so that row groups prune on ``video_id``.

    Not partitioned by video: that would make one small file per video.
    """
    arranged = (
        df.repartitionByRange(files_per_write, "video_id") if files_per_write else df.repartitionByRange("video_id")
    )
    arranged.sortWithinPartitions("video_id").write.mode("append").parquet(path)


def read_table(spark: SparkSession, family: str, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[family]).parquet(path)


def range_problems(df: DataFrame) -> DataFrame:
    """Rows whose range is negative or empty, or that start before the previous row of the manifest."""
    from tidemark.plans.ordered import ordered, running

    scan = running(
        ordered(df, ["video_id"], ["ord"]),
        {"_start": ("last", F.col("start_ms")), "_end": ("last", F.col("end_ms"))},
        inclusive=False,
    )
    problem = (
        F.when(F.col("start_ms") < 0, "negative_start")
        .when(F.col("start_ms") >= F.col("end_ms"), "empty_range")
        .when(
            (F.col("start_ms") < F.col("_start"))
            | ((F.col("start_ms") == F.col("_start")) & (F.col("end_ms") < F.col("_end"))),
            "out_of_order",
        )
    )
    return scan.done().select("video_id", "ord", problem.alias("problem")).where(F.col("problem").isNotNull())


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    return df.groupBy("video_id", id_column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
