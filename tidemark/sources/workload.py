"""Timelines derived from the star-schema tables, over their whole rows and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import read_table


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval per event on its user's timeline; ``modality`` from the event type."""
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    modality = (
        F.when(F.col("event_type") == "view", "visual_description")
        .when(F.col("event_type") == "click", "ocr")
        .otherwise("transcript")
    )
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        "event_id",
        "event_type",
        "value",
        start.alias("start_ms"),
        (start + F.floor(F.col("value") * 100_000).cast("bigint") + 1).alias("end_ms"),
        modality.alias("modality"),
    )


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript segment per conversation turn; the text is the whole turn."""
    text = F.trim(F.regexp_replace("text", "\\s+", " "))
    start = F.col("turn") * 5_000
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("ord"),
        F.concat_ws("_", F.lit("seg"), "conv_id", "turn").alias("segment_id"),
        start.alias("start_ms"),
        (start + 2_200 + F.length("text") % 2_600).alias("end_ms"),
        F.col("text").alias("raw_text"),
        text.alias("normalized_text"),
        F.col("role").alias("source"),
        F.lit("en").alias("language"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of every document as a subtitle segment."""
    lines = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"),
        F.col("lang").alias("language"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    text = F.trim(F.regexp_replace("line", "\\s+", " "))
    start = F.col("line_no").cast("bigint") * 4_000 + F.when(F.col("line_no") % 7 == 6, 3_500).otherwise(0)
    return (
        lines.withColumn("normalized_text", text)
        .where("normalized_text <> ''")
        .select(
            "video_id",
            F.col("line_no").cast("bigint").alias("ord"),
            F.concat_ws("_", F.lit("line"), "video_id", "line_no").alias("segment_id"),
            start.alias("start_ms"),
            (start + 1_500 + F.length("line") % 2_300).alias("end_ms"),
            F.col("line").alias("raw_text"),
            "normalized_text",
            F.lit("embedded_subtitle").alias("source"),
            "language",
        )
    )


def grid_shots(spans: DataFrame, shot_ms: int = 3_000) -> DataFrame:
    """Back-to-back shots of ``shot_ms`` from 0 up to each video's last end."""
    ends = spans.groupBy("video_id").agg(F.max("end_ms").alias("last"))
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("last") - 1) / shot_ms).cast("bigint")))
    return ends.select("video_id", number.alias("ord")).select(
        "video_id",
        "ord",
        F.concat_ws("_", F.lit("shot"), "video_id", "ord").alias("shot_id"),
        (F.col("ord") * shot_ms).alias("start_ms"),
        ((F.col("ord") + 1) * shot_ms).alias("end_ms"),
    )


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search items: id, text, a slot on a common timeline, tags."""
    item = F.col("doc_id").cast("string")
    return read_table(spark, sf_dir, "documents").select(
        item.alias("item_id"),
        "text",
        (F.col("doc_id") * 1_000).alias("start_ms"),
        (F.col("doc_id") * 1_000 + F.col("n_chars")).alias("end_ms"),
        F.array(item, F.col("source")).alias("source_ids"),
        F.array("lang", "source").alias("tags"),
    )


def conversation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = conversation_segments(spark, sf_dir)
    return segments.select(
        "video_id",
        F.col("segment_id").alias("item_id"),
        F.col("normalized_text").alias("text"),
        "start_ms",
        "end_ms",
        F.array(F.col("segment_id"), F.concat_ws("_", F.lit("conv"), "video_id")).alias("source_ids"),
        F.array("language", "source").alias("tags"),
    )


def embedding_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("vec_id").cast("string")
    return read_table(spark, sf_dir, "embeddings").select(
        item.alias("item_id"),
        (F.col("vec_id") * 1_000).alias("start_ms"),
        (F.col("vec_id") * 1_000 + 1_000).alias("end_ms"),
        F.array(item).alias("source_ids"),
        F.array(F.col("label").cast("string")).alias("tags"),
        F.col("embedding").alias("raw_vector"),
    )


def order_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as catalog entries, selections and stored files.

    A customer is a video, the order priority a resource key, the order key a
    revision.  Every later order of a customer depends on the first one.  Files
    of open ("P") orders are missing, those of orders under 50 000 were changed.
    """
    table = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    columns = {
        "video_id": F.col("o_custkey").cast("string"),
        "revision": F.col("o_orderkey"),
        "entry_id": F.concat(F.lit("entry_"), F.col("o_orderkey")),
        "key": F.concat_ws(":", F.lit("manifest"), F.col("o_orderpriority"), F.lit("primary")),
        "content_sha256": F.sha2(F.col("o_orderkey").cast("string"), 256),
        "uri": F.concat_ws("/", F.lit("/data/artifacts"), "o_custkey", "o_orderkey"),
        "size_bytes": F.floor("o_totalprice").cast("bigint"),
        "derivation_key": F.col("o_orderstatus"),
        "producer_name": F.lit("orders"),
        "producer_version": F.lit("1"),
    }
    named = [column.alias(name) for name, column in columns.items()]
    orders = table.select(*named, "o_totalprice")
    # texts and hashes are formed behind the join, which moves the numbers alone
    roots = table.groupBy("o_custkey").agg(F.min("o_orderkey").alias("root"))
    entries = table.join(roots, "o_custkey").select(
        *named,
        F.when(F.col("o_orderkey") == F.col("root"), F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("entry_"), F.col("root"))))
        .alias("dependency_entry_ids"),
    )
    selections = orders.select("video_id", "revision", "key", "entry_id")
    files = orders.where("derivation_key <> 'P'").select(
        "uri",
        F.when(F.col("o_totalprice") < 50_000, F.lit("0"))
        .otherwise(F.col("content_sha256"))
        .alias("sha256"),
    )
    return entries, selections, files
