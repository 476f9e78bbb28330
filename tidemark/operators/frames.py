"""Which timestamps to sample, frame-to-shot links, frame de-duplication, even picks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timecodes import round_half_even
from tidemark.plans.folds import fold_rows
from tidemark.plans.ordered import ScanPolicy, numbered, ordered, running
from tidemark.plans.overlap import overlap_join, point_in_interval_join


@dataclass(frozen=True)
class SamplingPlan:
    strategy: str
    fps: float | None
    max_frames: int


def sampling_plan(detail: str, targets: int) -> SamplingPlan:
    """Detail level and number of targets to a strategy and a frame budget."""
    if detail == "coarse":
        return SamplingPlan("shot_keyframe", None, min(16, max(4, targets * 2)))
    if detail == "detailed":
        return SamplingPlan("dense_window", 1.0, min(48, max(12, targets * 8)))
    if detail == "standard":
        return SamplingPlan("shot_keyframe", None, min(24, max(8, targets * 4)))
    raise ValueError(f"unknown detail: {detail}")


def sampling_plans(targets: DataFrame) -> DataFrame:
    """The same table for many videos: ``video_id, detail, n_targets`` in."""
    n = F.col("n_targets")
    coarse, detailed = F.col("detail") == "coarse", F.col("detail") == "detailed"
    return targets.withColumns(
        {
            "strategy": F.when(detailed, "dense_window").otherwise("shot_keyframe"),
            "fps": F.when(detailed, F.lit(1.0)),
            "max_frames": F.when(coarse, F.least(F.lit(16), F.greatest(F.lit(4), n * 2)))
            .when(detailed, F.least(F.lit(48), F.greatest(F.lit(12), n * 8)))
            .otherwise(F.least(F.lit(24), F.greatest(F.lit(8), n * 4))),
        }
    )


def uniform_timestamps(ranges: DataFrame, count: int, policy: ScanPolicy | None = None) -> DataFrame:
    """``count`` timestamps per video spread evenly over its ranges laid end to end.

    The ranges' offsets on the joined axis are a running sum; each offset then
    finds its range with a point-in-interval join.
    """
    lengths = ranges.select("video_id", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("_len"))
    scan = running(
        ordered(lengths, ["video_id"], ["start_ms", "end_ms"], policy), {"_to": ("sum", F.col("_len"))}
    )
    axis = scan.done().select(
        "video_id", "start_ms", (F.col("_to") - F.col("_len")).alias("_from"), "_to"
    )
    totals = lengths.groupBy("video_id").agg(F.sum("_len").alias("total"))
    wanted = F.least(F.lit(count).cast("bigint"), F.col("total"))
    points = totals.select(
        "video_id", "total", wanted.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), wanted - 1)).alias("i")
    ).select(
        "video_id",
        "i",
        F.least(
            round_half_even((F.col("i") + 0.5) * F.col("total") / F.col("n")), F.col("total") - 1
        ).alias("_offset"),
    )
    located = point_in_interval_join(points, axis, ["video_id"], "_offset", "_from", "_to")
    return located.select(
        "video_id", "i", (F.col("start_ms") + F.col("_offset") - F.col("_from")).alias("timestamp_ms")
    )


def fixed_rate_timestamps(
    ranges: DataFrame, fps: float, max_frames: int | None = None, policy: ScanPolicy | None = None
) -> DataFrame:
    """Every ``round(1000/fps)`` ms inside each range, cut at ``max_frames`` per video.

    How many timestamps a range may still contribute is known from a running
    count over the ranges, so none beyond the limit are generated.
    """
    if fps <= 0:
        raise ValueError("fps must be positive")
    step = max(1, round(1000 / fps))
    length = F.col("end_ms") - F.col("start_ms")
    sized = ranges.select(
        "video_id", "start_ms", "end_ms", F.ceil(length / F.lit(step)).cast("bigint").alias("_n")
    )
    if max_frames is not None:
        scan = running(
            ordered(sized, ["video_id"], ["start_ms", "end_ms"], policy),
            {"_before": ("sum", F.col("_n"))},
            inclusive=False,
        )
        left = F.lit(max_frames) - F.coalesce("_before", F.lit(0))
        sized = scan.done().withColumn("_n", F.least("_n", left)).where("_n > 0")
    return sized.select(
        "video_id",
        F.explode(
            F.sequence(
                F.col("start_ms"), F.col("start_ms") + (F.col("_n") - 1) * step, F.lit(step).cast("bigint")
            )
        ).alias("timestamp_ms"),
    )


def keyframe_timestamps(
    ranges: DataFrame, shots: DataFrame, max_frames: int | None = None
) -> DataFrame:
    """Floor midpoints of every shot's overlap with every range, distinct, earliest first."""
    right = shots.select(
        "video_id", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms")
    )
    pairs = overlap_join(ranges.select("video_id", "start_ms", "end_ms"), right)
    low, high = F.greatest("start_ms", "r_start_ms"), F.least("end_ms", "r_end_ms")
    midpoints = pairs.select("video_id", F.call_function("shiftright", low + high, F.lit(1)).alias("timestamp_ms")).distinct()
    if max_frames is None:
        return midpoints
    earliest = Window.partitionBy("video_id").orderBy("timestamp_ms")
    return midpoints.withColumn("_n", F.row_number().over(earliest)).where(F.col("_n") <= max_frames).drop("_n")


def frame_shots(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """Add ``segment_ids``: shots whose range holds the frame's timestamp."""
    spans = shots.select("video_id", F.col("ord").alias("_ord"), "shot_id", "start_ms", "end_ms")
    points = frames.select("video_id", "frame_id", "timestamp_ms")
    linked = (
        point_in_interval_join(points, spans, ["video_id"], "timestamp_ms", "start_ms", "end_ms")
        .groupBy("video_id", "frame_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_ord", "shot_id"))), lambda s: s["shot_id"]
            ).alias("segment_ids")
        )
    )
    return frames.join(linked, ["video_id", "frame_id"], "left").withColumn(
        "segment_ids", F.coalesce("segment_ids", F.array().cast("array<string>"))
    )


def target_frames(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """``frame_ids`` of each target in time order; targets without a frame are dropped.

    A request decodes a bounded number of frames, so the lists are short.
    """
    points = frames.select("video_id", "frame_id", "timestamp_ms")
    return (
        point_in_interval_join(
            points,
            targets.select("video_id", "target_id", "start_ms", "end_ms"),
            ["video_id"],
            "timestamp_ms",
            "start_ms",
            "end_ms",
        )
        .groupBy("video_id", "target_id", "start_ms", "end_ms")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("timestamp_ms", "frame_id"))), lambda f: f["frame_id"]
            ).alias("frame_ids")
        )
    )


class _NewPictureRule:
    """Keep a frame whose mean absolute difference to the last kept one reaches the threshold."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.last: np.ndarray | None = None

    def __call__(self, row: tuple, fresh: bool) -> bool:
        signature = np.asarray(row[0], dtype="float64")
        if not fresh and self.last is not None:
            if float(np.abs(signature - self.last).mean()) < self.threshold:
                return False
        self.last = signature
        return True


def distinct_frames(
    frames: DataFrame, threshold: float = 2.0, keys: tuple[str, ...] = ("video_id",)
) -> DataFrame:
    """Drop frames that look like the last *kept* frame of the same request.

    ``signature`` is the numeric thumbnail (32 x 32 grey values for pictures).
    """
    flagged = fold_rows(
        frames,
        list(keys),
        ["timestamp_ms", "frame_id"],
        ["signature"],
        lambda: _NewPictureRule(threshold),
        "_kept",
        T.BooleanType(),
    )
    return flagged.where("_kept").drop("_kept")


def even_selection(
    items: DataFrame, count: int, order: tuple[str, ...] = ("start_ms", "end_ms"), policy: ScanPolicy | None = None
) -> DataFrame:
    """``count`` evenly spread rows per video; all of them when there are no more."""
    if count <= 0:
        raise ValueError("count must be positive")
    placed = numbered(ordered(items, ["video_id"], list(order), policy), "_pos").done()
    sizes = items.groupBy("video_id").agg(F.count(F.lit(1)).alias("_m"))
    if count == 1:
        index = F.floor(F.col("_m") / 2)
    else:
        index = round_half_even(F.col("_i") * (F.col("_m") - 1) / F.lit(count - 1))
    picks = (
        sizes.where(F.col("_m") > count)
        .select("video_id", "_m", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_i"))
        .select("video_id", index.cast("bigint").alias("_pos"))
    )
    everything = sizes.where(F.col("_m") <= count).select(
        "video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)).alias("_pos")
    )
    wanted = picks.unionByName(everything).distinct()
    return placed.join(wanted, ["video_id", "_pos"], "left_semi").drop("_pos")
