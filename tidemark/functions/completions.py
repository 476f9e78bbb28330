"""Coercing and checking what a visual model returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETION_SCHEMA = "description STRING, tags ARRAY<STRING>, confidence STRING"


def strip_code_fence(content: Column) -> Column:
    """The JSON inside a fenced block, or the trimmed text itself."""
    fenced = F.regexp_extract(content, "(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$", 1)
    return F.when(fenced != "", fenced).otherwise(F.trim(content))


def parse_completion(content: Column) -> Column:
    """``struct(description, tags, confidence)``; NULL when there is no usable description.

    Tags are trimmed and made distinct; a confidence that is not a number in
    0..1 becomes NULL.
    """
    parsed = F.from_json(strip_code_fence(content), COMPLETION_SCHEMA)
    description = F.trim(parsed["description"])
    tags = F.array_distinct(
        F.filter(F.transform(parsed["tags"], lambda tag: F.trim(tag)), lambda tag: tag.isNotNull() & (tag != ""))
    )
    confidence = parsed["confidence"].try_cast("double")
    return F.when(
        description != "",
        F.struct(
            description.alias("description"),
            F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
            F.when((confidence >= 0) & (confidence <= 1), confidence).alias("confidence"),
        ),
    )


def response_problems(observations: DataFrame, targets: DataFrame) -> DataFrame:
    """``request_id, target_id, problem`` for answers that break the model contract.

    ``observations``: ``request_id, target_id, text, frame_ids, tags, confidence``;
    ``targets``: ``request_id, target_id, frame_ids``.
    """
    keys = ["request_id", "target_id"]
    counted = observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = targets.select(*keys, F.col("frame_ids").alias("_allowed"))
    joined = observations.join(counted, keys).join(known, keys, "left")
    problem = (
        F.when(F.col("_allowed").isNull(), "unknown_target")
        .when(F.col("_n") > 1, "duplicate_target")
        .when(F.trim("text") == "", "empty_text")
        .when(F.size(F.array_except("frame_ids", "_allowed")) > 0, "foreign_frames")
        .when(F.exists("tags", lambda tag: F.trim(tag) == ""), "empty_tag")
        .when(F.size(F.array_distinct("tags")) < F.size("tags"), "duplicate_tag")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence_out_of_range")
    )
    return joined.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())
