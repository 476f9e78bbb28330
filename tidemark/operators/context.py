"""Timeline context around search hits, ranges or chunk ids."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ranges import merge_ranges
from tidemark.plans.folds import fold_rows
from tidemark.plans.ordered import ScanPolicy
from tidemark.plans.overlap import overlap_semi


class Direction(StrEnum):
    BEFORE = "before"
    AFTER = "after"
    BOTH = "both"


def requested_ranges(
    chunks: DataFrame,
    ranges: DataFrame | None = None,
    hits: DataFrame | None = None,
    chunk_ids: DataFrame | None = None,
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Merged union of explicit ranges, hit ranges and the ranges of named chunks."""
    parts = [part.select("video_id", "start_ms", "end_ms") for part in (ranges, hits) if part is not None]
    if chunk_ids is not None:
        named = chunks.join(chunk_ids.select("video_id", "chunk_id").distinct(), ["video_id", "chunk_id"], "left_semi")
        parts.append(named.select("video_id", "start_ms", "end_ms"))
    if not parts:
        raise ValueError("context needs ranges, hits or chunk ids")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return merge_ranges(union, policy=policy)


def context_chunks(
    chunks: DataFrame,
    requested: DataFrame,
    adjacent_chunks: int = 0,
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Chunks overlapping a requested range and their neighbours by position."""
    if adjacent_chunks < 0:
        raise ValueError("adjacent_chunks must not be negative")
    selected = overlap_semi(chunks, requested, policy=policy)
    if adjacent_chunks == 0:
        return selected
    around = F.sequence(F.col("ord") - adjacent_chunks, F.col("ord") + adjacent_chunks)
    wanted = selected.select("video_id", F.explode(around).alias("ord")).distinct()
    return chunks.join(wanted, ["video_id", "ord"], "left_semi")


def timeline_context(
    chunks: DataFrame,
    shots: DataFrame,
    segments: DataFrame,
    requested: DataFrame,
    adjacent_chunks: int = 0,
    policy: ScanPolicy | None = None,
) -> dict[str, DataFrame]:
    """``chunks``, ``resolved`` ranges, and the ``shots`` and ``segments`` inside them."""
    selected = context_chunks(chunks, requested, adjacent_chunks, policy)
    observed = selected.select(
        "video_id",
        F.coalesce("insp_start_ms", "start_ms").alias("start_ms"),
        F.coalesce("insp_end_ms", "end_ms").alias("end_ms"),
    )
    resolved = merge_ranges(observed, policy=policy)
    return {
        "requested": requested,
        "chunks": selected,
        "resolved": resolved,
        "shots": overlap_semi(shots, resolved, policy=policy),
        "segments": overlap_semi(segments, resolved, policy=policy),
    }


class _BudgetRule:
    """Admit rows while the running duration fits; later shorter rows may still fit."""

    def __init__(self, budget_ms: int) -> None:
        self.budget_ms = budget_ms
        self.used = 0

    def __call__(self, row: tuple, fresh: bool) -> bool:
        anchored_ms, duration_ms = row
        if fresh:
            self.used = anchored_ms
        if self.used + duration_ms > self.budget_ms:
            return False
        self.used += duration_ms
        return True


def budgeted_context(
    chunks: DataFrame,
    anchors: DataFrame,
    direction: Direction = Direction.BOTH,
    adjacent_chunks: int = 1,
    max_duration_ms: int = 120_000,
) -> DataFrame:
    """Anchor chunks plus nearest neighbours that fit the duration budget.

    ``anchors``: ``video_id, ord``, one request per video.  Neighbours are tried
    nearest first, equal distances in chunk order; one that does not fit is
    skipped and reported as ``admitted = false``.  Anchors always stay.
    """
    before = -adjacent_chunks if direction in (Direction.BEFORE, Direction.BOTH) else 0
    after = adjacent_chunks if direction in (Direction.AFTER, Direction.BOTH) else 0
    offsets = F.explode(F.sequence(F.lit(before), F.lit(after)))
    reachable = (
        anchors.select("video_id", "ord")
        .distinct()
        .select("video_id", "ord", offsets.alias("offset"))
        .groupBy("video_id", (F.col("ord") + F.col("offset")).alias("ord"))
        .agg(F.min(F.abs("offset")).alias("distance"))
    )
    length = F.coalesce("insp_end_ms", "end_ms") - F.coalesce("insp_start_ms", "start_ms")
    placed = chunks.withColumn("duration_ms", length).join(reachable, ["video_id", "ord"])
    anchored = (
        placed.where("distance = 0").groupBy("video_id").agg(F.sum("duration_ms").alias("anchored_ms"))
    )
    candidates = placed.where("distance > 0").join(anchored, "video_id")
    admitted = fold_rows(
        candidates,
        ["video_id"],
        ["distance", "ord"],
        ["anchored_ms", "duration_ms"],
        lambda: _BudgetRule(max_duration_ms),
        "admitted",
        T.BooleanType(),
    ).drop("anchored_ms")
    return placed.where("distance = 0").withColumn("admitted", F.lit(True)).unionByName(admitted)
