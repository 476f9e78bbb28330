"""Content-addressed registration of media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def filename_problem(name: Column) -> Column:
    """Why a name is not a plain file name; NULL when it is one."""
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "Video filename must be a non-empty string.")
        .when(F.instr(name, "\u0000") > 0, "Video filename must not contain null characters.")
        .when(
            name.isin(".", "..") | name.contains("/") | name.contains("\\"),
            "Video input must be a plain filename without path components.",
        )
    )


def register_videos(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below ``root``: ``video_id = video_<sha256>``, size and modification time.

    Each file is hashed inside a task; contents never leave it.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    )
    digest = F.sha2("content", 256)
    return files.select(
        F.concat(F.lit("video_"), digest).alias("video_id"),
        F.element_at(F.split("path", "/"), -1).alias("display_name"),
        F.col("path").alias("uri"),
        digest.alias("sha256"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def changed_files(registered: DataFrame, current: DataFrame) -> DataFrame:
    """Registered files whose size or modification time differs now, or that are gone."""
    now = current.select("uri", F.col("size_bytes").alias("_size"), F.col("modified_at").alias("_at"))
    joined = registered.join(now, "uri", "left")
    problem = F.when(F.col("_size").isNull(), "missing").when(
        (F.col("_size") != F.col("size_bytes")) | (F.col("_at") != F.col("modified_at")), "file_changed"
    )
    return joined.select("video_id", "uri", problem.alias("problem")).where(F.col("problem").isNotNull())
