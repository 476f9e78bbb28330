"""Artifacts of search hits: the pictures behind a hit's source ids, and their union over fused lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hit_artifacts(hits: DataFrame, frames: DataFrame, scope: Sequence[str] = ("video_id",)) -> DataFrame:
    """``scope, modality, source_id, rank, position, artifact_id, uri``: one row for each picture of a hit.

    ``hits``: ``scope, modality, rank, source_ids``; ``frames``: ``scope, frame_id, artifact_id,
    uri``.  A hit's pictures are those of its source ids that are frames, in their order;
    ``source_id`` is its first id, which names the item.  Of repeated frames the last by uri counts.
    """
    scope = list(scope)
    placed = hits.select(*scope, "modality", "rank", F.col("source_ids")[0].alias("source_id"), F.posexplode("source_ids").alias("position", "frame_id"))
    known = frames.groupBy(*scope, "frame_id").agg(F.max(F.struct("uri", "artifact_id")).alias("picture"))
    return placed.join(known, [*scope, "frame_id"]).select(
        *scope, "modality", "source_id", "rank", "position", F.col("picture.artifact_id").alias("artifact_id"), F.col("picture.uri").alias("uri")
    )


def distinct_artifacts(lists: Sequence[DataFrame], scope: Sequence[str] = ("video_id",)) -> DataFrame:
    """``scope, modality, source_id, place, artifact_id, uri``: each item's pictures over all lists, once each.

    ``lists`` are results of :func:`hit_artifacts`, in the order in which they are read.  A
    picture keeps the place where it is met first, from 0, and what was said of it last.
    Sums over rows only: an item may have any number of pictures in any number of lists.
    """
    item = [*scope, "modality", "source_id"]
    rows = None
    for number, one in enumerate(lists):
        part = one.select(*item, F.struct(F.lit(number).alias("list_no"), "rank", "position").alias("at"), "artifact_id", "uri")
        rows = part if rows is None else rows.unionByName(part)
    merged = rows.groupBy(*item, "artifact_id").agg(F.min("at").alias("_first"), F.max_by("uri", F.struct("at", "uri")).alias("uri"))
    order = Window.partitionBy(*item).orderBy("_first", "artifact_id")
    return merged.select(*item, (F.row_number().over(order) - 1).cast("bigint").alias("place"), "artifact_id", "uri")


def fused_artifacts(fused: DataFrame, artifacts: DataFrame, scope: Sequence[str] = ("video_id",)) -> DataFrame:
    """``scope, rank, source_id, place, artifact_id, uri`` of fused hits, which are no more than ``top_k`` a scope."""
    item = [*scope, "modality", "source_id"]
    return fused.select(*item, "rank").join(artifacts, item).select(*scope, "rank", "source_id", "place", "artifact_id", "uri")
