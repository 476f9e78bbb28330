"""Search indexes on storage: one Parquet table per kind, partitioned by modality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_INDEX_COLUMNS = (
    "video_id", "item_id", "text", "start_ms", "end_ms", "source_ids", "tags", "token_counts", "doc_length",
)
DENSE_INDEX_COLUMNS = (
    "video_id", "item_id", "text", "start_ms", "end_ms", "source_ids", "tags", "vector", "embedding_space", "dimensions",
)


def write_text_index(index: DataFrame, path: str, modality: str) -> None:
    _write(index.select(*TEXT_INDEX_COLUMNS), path, modality)


def write_dense_index(index: DataFrame, path: str, modality: str, embedding_space: str, dimensions: int) -> None:
    typed = index.withColumns(
        {
            "vector": F.col("vector").cast("array<float>"),
            "embedding_space": F.lit(embedding_space),
            "dimensions": F.lit(dimensions),
        }
    )
    _write(typed.select(*DENSE_INDEX_COLUMNS), path, modality)


def _write(index: DataFrame, path: str, modality: str) -> None:
    (
        index.withColumn("modality", F.lit(modality))
        .repartitionByRange("video_id")
        .sortWithinPartitions("video_id", "start_ms")
        .write.mode("append")
        .partitionBy("modality")
        .parquet(path)
    )


def read_text_index(spark: SparkSession, path: str, modality: str, video_id: str | None = None) -> DataFrame:
    return _read(spark, path, modality, video_id)


def read_dense_index(
    spark: SparkSession, path: str, modality: str, embedding_space: str, dimensions: int, video_id: str | None = None
) -> DataFrame:
    """Rows of another embedding space or width fail the query instead of scoring wrongly."""
    index = _read(spark, path, modality, video_id)
    fits = (
        (F.col("embedding_space") == embedding_space)
        & (F.col("dimensions") == dimensions)
        & (F.size("vector") == dimensions)
    )
    checked = F.when(fits, F.col("vector")).otherwise(
        F.raise_error(F.lit("query and index use different embedding spaces or dimensions"))
    )
    return index.withColumn("vector", checked.cast("array<double>"))


def _read(spark: SparkSession, path: str, modality: str, video_id: str | None) -> DataFrame:
    index = spark.read.parquet(path).where(F.col("modality") == modality)
    return index if video_id is None else index.where(F.col("video_id") == video_id)
