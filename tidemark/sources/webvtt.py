"""WebVTT subtitle files to transcript segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import plain_text
from tidemark.functions.timecodes import vtt_timestamp_ms

# Fixed value: a cue timing inside one block of non-blank lines.
_STAMP = "((?:\\d{2}:)?\\d{2}:\\d{2}\\.\\d{3})"
CUE_PATTERN = f"(?s)^.*?{_STAMP}[^\\S\\n]+-->[^\\S\\n]+{_STAMP}[^\\n]*(?:\\n(.*))?$"


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """``video_id`` (file name without extension) and whole ``text`` of each file."""
    files = spark.read.text(path, wholetext=True).withColumn("_path", F.input_file_name())
    name = F.element_at(F.split("_path", "/"), -1)
    return files.select(F.regexp_replace(name, "\\.[^.]*$", "").alias("video_id"), F.col("value").alias("text"))


def parse_vtt(files: DataFrame, language: str | None = None, stream_index: int | None = None) -> DataFrame:
    """Cues of ``video_id, text`` rows as segments.

    A cue is the first timing line of a block plus the lines after it.  Markup
    and entities are resolved, empty or non-positive cues dropped.  ``ord`` is
    time order; ids follow file order.  One file is one row, so the per-file
    numbering never sees more than a row's worth of cues.
    """
    lines = F.regexp_replace(F.regexp_replace("text", "^\\x{FEFF}", ""), "\\R|[\\x1c-\\x1e]", "\n")
    blocks = F.split(lines, "(?U)\\n(?:[^\\S\\n]*\\n)+")
    cues = files.select("video_id", F.posexplode(blocks).alias("block_no", "block")).where(
        F.col("block").rlike(CUE_PATTERN)
    )
    body_lines = F.transform(F.split(F.regexp_extract("block", CUE_PATTERN, 3), "\n"), lambda line: F.trim(line))
    timed = cues.select(
        "video_id",
        "block_no",
        vtt_timestamp_ms(F.regexp_extract("block", CUE_PATTERN, 1)).alias("start_ms"),
        vtt_timestamp_ms(F.regexp_extract("block", CUE_PATTERN, 2)).alias("end_ms"),
        F.trim(F.array_join(F.filter(body_lines, lambda line: line != ""), " ")).alias("raw_text"),
    ).where("end_ms > start_ms")
    kept = timed.withColumn("normalized_text", plain_text(F.col("raw_text"))).where("normalized_text <> ''")
    in_file = Window.partitionBy("video_id").orderBy("block_no")
    in_time = Window.partitionBy("video_id").orderBy("start_ms", "end_ms", "block_no")
    number = F.row_number().over(in_file) - 1
    return kept.select(
        "video_id",
        (F.row_number().over(in_time) - 1).cast("bigint").alias("ord"),
        F.concat(F.lit("subtitle_"), F.col("video_id"), F.lit("_"), F.format_string("%06d", number)).alias("segment_id"),
        "start_ms",
        "end_ms",
        "raw_text",
        "normalized_text",
        F.lit("embedded_subtitle").alias("source"),
        F.lit(language).cast("string").alias("language"),
        F.lit(stream_index).cast("int").alias("source_stream_index"),
    )
