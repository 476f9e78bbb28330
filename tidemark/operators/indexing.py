"""Building index documents and postings from manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tokenize
from tidemark.functions.vectors import normalize_vector
from tidemark.plans.overlap import overlap_join
from tidemark.plans.ranks import expanded, rank_ranges, ranked

_NO_STRINGS = "array<string>"


def overlapping_ids(
    items: DataFrame, spans: DataFrame, id_column: str, output: str, item_key: str = "item_id", disjoint: bool = False
) -> DataFrame:
    """``video_id, item_key, output``: ids of the spans each item overlaps, in span order.

    ``disjoint``: the spans of a video do not overlap each other; an item's spans are then
    one run of ranks, and only what is listed is joined.
    """
    if disjoint:
        found = rank_ranges(items, spans, [item_key])
        long = expanded(found, ranked(spans.select("video_id", "start_ms", "end_ms", F.col("ord").alias("_ord"), F.col(id_column).alias("_id"))))
        return _listed(long, item_key, output)
    right = spans.select(
        "video_id",
        F.col(id_column).alias("_id"),
        F.col("ord").alias("_ord"),
        F.col("start_ms").alias("r_start_ms"),
        F.col("end_ms").alias("r_end_ms"),
    )
    pairs = overlap_join(items.select("video_id", item_key, "start_ms", "end_ms"), right)
    return _listed(pairs, item_key, output)


def _listed(pairs: DataFrame, item_key: str, output: str) -> DataFrame:
    ids = F.array_sort(F.collect_list(F.struct("_ord", "_id")))
    return pairs.groupBy("video_id", item_key).agg(
        F.transform(ids, lambda entry: entry["_id"]).alias(output)
    )


def _ids(*parts: Column) -> Column:
    safe = [F.coalesce(part, F.array().cast(_NO_STRINGS)) for part in parts]
    return F.array_distinct(F.concat(*safe))


def transcript_documents(segments: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """Chunk documents; videos without any chunk text fall back to segments.

    Chunk tags are the distinct languages and sources of its segments in segment
    order.  Fallback documents link chunks by membership, not by overlap.
    """
    segment_tags = F.filter(F.array("language", "source"), lambda tag: tag.isNotNull() & (tag != ""))
    fallback_base = segments.select(
        "video_id",
        F.col("segment_id").alias("item_id"),
        F.col("normalized_text").alias("text"),
        "start_ms",
        "end_ms",
        segment_tags.alias("tags"),
    )
    if chunks is None:
        return fallback_base.withColumn("source_ids", F.array("item_id"))
    member = chunks.select("video_id", "chunk_id", "ord", "text", F.explode("segment_ids").alias("segment_id"))
    tagged = segments.select("video_id", "segment_id", F.col("ord").alias("seg_ord"), segment_tags.alias("tags"))
    chunk_tags = (
        member.where(F.col("text").isNotNull())
        .join(tagged, ["video_id", "segment_id"])
        .groupBy("video_id", "chunk_id")
        .agg(F.array_sort(F.collect_list(F.struct("seg_ord", "tags"))).alias("_t"))
        .select(
            "video_id",
            "chunk_id",
            F.array_distinct(F.flatten(F.transform("_t", lambda t: t["tags"]))).alias("tags"),
        )
    )
    shot_ids = F.col("shot_ids") if "shot_ids" in chunks.columns else F.array().cast(_NO_STRINGS)
    documents = (
        chunks.where(F.col("text").isNotNull())
        .join(chunk_tags, ["video_id", "chunk_id"], "left")
        .select(
            "video_id",
            F.col("chunk_id").alias("item_id"),
            "text",
            "start_ms",
            "end_ms",
            _ids(F.array("chunk_id"), F.col("segment_ids"), shot_ids).alias("source_ids"),
            F.coalesce("tags", F.array().cast(_NO_STRINGS)).alias("tags"),
        )
    )
    covered = documents.select("video_id").distinct()
    linked = member.groupBy("video_id", F.col("segment_id").alias("item_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda c: c["chunk_id"]
        ).alias("_chunks")
    )
    fallback = (
        fallback_base.join(covered, "video_id", "left_anti")
        .join(linked, ["video_id", "item_id"], "left")
        .select(
            "video_id",
            "item_id",
            "text",
            "start_ms",
            "end_ms",
            _ids(F.array("item_id"), F.col("_chunks")).alias("source_ids"),
            "tags",
        )
    )
    return documents.unionByName(fallback)


def ocr_documents(
    observations: DataFrame, spans: DataFrame | None, chunks: DataFrame | None, disjoint: bool = False
) -> DataFrame:
    """Span documents, or 1 ms observation documents for videos without spans.

    ``spans``: ``video_id, span_id, start_ms, end_ms, text, observation_ids``.
    """
    single = observations.select(
        "video_id",
        F.col("observation_id").alias("item_id"),
        F.col("normalized_text").alias("text"),
        F.col("timestamp_ms").alias("start_ms"),
        (F.col("timestamp_ms") + 1).alias("end_ms"),
        F.array("observation_id", "frame_id").alias("_own"),
        F.filter(F.array("language"), lambda v: v.isNotNull()).alias("tags"),
    )
    documents = single
    if spans is not None:
        exploded = spans.select("video_id", "span_id", F.posexplode("observation_ids").alias("pos", "observation_id"))
        looked_up = (
            exploded.join(
                observations.select("video_id", "observation_id", "frame_id", "language"),
                ["video_id", "observation_id"],
            )
            .groupBy("video_id", "span_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "frame_id", "language"))).alias("_o"))
        )
        from_spans = spans.join(looked_up, ["video_id", "span_id"], "left").select(
            "video_id",
            F.col("span_id").alias("item_id"),
            "text",
            "start_ms",
            "end_ms",
            _ids(
                F.array("span_id"),
                F.col("observation_ids"),
                F.transform("_o", lambda o: o["frame_id"]),
            ).alias("_own"),
            F.array_distinct(
                F.filter(F.transform("_o", lambda o: o["language"]), lambda v: v.isNotNull())
            ).alias("tags"),
        )
        with_spans = spans.select("video_id").distinct()
        documents = from_spans.unionByName(single.join(with_spans, "video_id", "left_anti"))
    return _link_overlaps(documents, [(chunks, "chunk_id")], disjoint)


def visual_documents(
    descriptions: DataFrame, chunks: DataFrame | None, shots: DataFrame | None = None, disjoint: bool = False
) -> DataFrame:
    """Description documents with frame ids, then overlapping chunk ids, then shot ids."""
    documents = descriptions.select(
        "video_id",
        F.col("description_id").alias("item_id"),
        "text",
        "start_ms",
        "end_ms",
        _ids(F.array("description_id"), F.col("frame_ids")).alias("_own"),
        "tags",
    )
    return _link_overlaps(documents, [(chunks, "chunk_id"), (shots, "shot_id")], disjoint)


def _link_overlaps(documents: DataFrame, tables: Sequence[tuple[DataFrame | None, str]], disjoint: bool) -> DataFrame:
    linked, parts = documents, [F.col("_own")]
    for number, (table, id_column) in enumerate(tables):
        if table is None:
            continue
        name = f"_related_{number}"
        linked = linked.join(
            overlapping_ids(documents, table, id_column, name, disjoint=disjoint), ["video_id", "item_id"], "left"
        )
        parts.append(F.col(name))
    return linked.select(
        "video_id", "item_id", "text", "start_ms", "end_ms", _ids(*parts).alias("source_ids"), "tags"
    )


def postings(documents: DataFrame, keys: Sequence[str] = ("video_id", "item_id")) -> DataFrame:
    """``keys, term, tf``.  A document's tokens meet in one map task, so the partial
    aggregate already leaves one row per (document, term) before the shuffle."""
    return (
        documents.select(*keys, F.explode(tokenize(F.col("text"))).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def text_index(documents: DataFrame, keys: Sequence[str] = ("video_id", "item_id")) -> DataFrame:
    """Documents with ``token_counts`` and ``doc_length`` instead of a text to parse per search.

    The counts of one document are bounded by its own vocabulary.
    """
    keys = list(keys)
    counts = postings(documents, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("token_counts"),
        F.sum("tf").alias("doc_length"),
    )
    empty = F.create_map().cast("map<string,bigint>")
    return documents.join(counts, keys, "left").withColumns(
        {
            "token_counts": F.coalesce("token_counts", empty),
            "doc_length": F.coalesce("doc_length", F.lit(0)),
        }
    )


def dense_index(documents: DataFrame, embeddings: DataFrame, dimensions: int) -> DataFrame:
    """Documents joined with their embeddings, normalised to unit length.

    Items belong to a video where both sides name one; the same item id of another
    video is another item.
    """
    keys = [c for c in ("video_id", "item_id") if c in embeddings.columns and c in documents.columns]
    vectors = embeddings.select(*keys, normalize_vector(F.col("vector"), dimensions).alias("vector"))
    return documents.join(vectors, keys)
