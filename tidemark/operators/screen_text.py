"""On-screen text: detections to observations, and observations to text spans."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.geometry import normalized_bbox
from tidemark.functions.text import normalize_compat
from tidemark.plans.folds import RUN, cut_at_pauses, fold_rows
from tidemark.plans.ordered import ScanPolicy, ordered


@dataclass(frozen=True)
class OcrParams:
    min_confidence: float = 0.5
    max_merge_gap_ms: int = 1_500
    min_text_similarity: float = 0.85
    min_bbox_iou: float = 0.25
    min_span_occurrences: int = 1


def check_results(results: DataFrame, frames: DataFrame) -> DataFrame:
    """``video_id, frame_id, problem``: duplicate, unknown (errors) or missing (warning)."""
    keys = ["video_id", "frame_id"]
    counted = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    duplicate = counted.where("n > 1").select(*keys, F.lit("duplicate").alias("problem"))
    unknown = counted.join(frames, keys, "left_anti").select(*keys, F.lit("unknown").alias("problem"))
    missing = frames.join(counted, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    return duplicate.unionByName(unknown).unionByName(missing)


def observations(
    detections: DataFrame, frames: DataFrame, params: OcrParams = OcrParams(), language: str | None = None
) -> DataFrame:
    """Usable detections with normalised text and box.

    ``detections``: ``video_id, frame_id, detection_no, text, polygon, confidence,
    width, height``.  The confidence filter runs before the Python text step.
    """
    confident = detections.where(F.col("confidence") >= params.min_confidence)
    boxed = confident.withColumn(
        "bbox", normalized_bbox(F.col("polygon"), F.col("width"), F.col("height"))
    ).where(F.col("bbox").isNotNull())
    plain = boxed.withColumn("normalized_text", normalize_compat(F.col("text"))).where(
        "normalized_text <> ''"
    )
    return plain.join(frames.select("video_id", "frame_id", "timestamp_ms"), ["video_id", "frame_id"]).select(
        "video_id",
        F.concat_ws("_", F.lit("ocr"), "frame_id", F.format_string("%06d", "detection_no")).alias("observation_id"),
        "frame_id",
        "timestamp_ms",
        F.trim("text").alias("raw_text"),
        "normalized_text",
        "bbox",
        "confidence",
        F.lit(language).cast("string").alias("language"),
    )


class _TrackRule:
    """Open tracks of one run: the last observation of each."""

    def __init__(self, params: OcrParams) -> None:
        self.params = params
        self.tracks: list[list] = []
        self.created = 0

    def __call__(self, row: tuple, fresh: bool) -> int:
        timestamp, text, box = row
        folded = text.casefold()
        p = self.params
        if fresh:
            self.tracks, self.created = [], 0
        self.tracks = [t for t in self.tracks if timestamp - t[1] <= p.max_merge_gap_ms]
        best, best_score = None, None
        for track in self.tracks:
            overlap = _iou(box, track[3])
            if overlap < p.min_bbox_iou:
                continue
            score = (self._similarity(folded, track[2]), overlap)
            if score[0] >= p.min_text_similarity and (best is None or score > best_score):
                best, best_score = track, score
        if best is None:
            best = [self.created, timestamp, folded, box]
            self.tracks.append(best)
            self.created += 1
        best[1:] = [timestamp, folded, box]
        return best[0]

    def _similarity(self, folded: str, other: str) -> float:
        """The match ratio, or 0 where a bound already says that it is below the threshold."""
        least = self.params.min_text_similarity
        if folded == other:
            return 1.0
        # the ratio is twice the matched share of both lengths, and 1 for equal texts alone
        if least >= 1 or 2 * min(len(folded), len(other)) < least * (len(folded) + len(other)):
            return 0.0
        matcher = SequenceMatcher(None, folded, other)
        return matcher.ratio() if matcher.quick_ratio() >= least else 0.0


def _iou(a: dict, b: dict) -> float:
    width = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    height = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
    shared = max(0.0, width) * max(0.0, height)
    if shared == 0:
        return 0.0
    return shared / (a["width"] * a["height"] + b["width"] * b["height"] - shared)


def assign_tracks(
    observed: DataFrame, params: OcrParams = OcrParams(), policy: ScanPolicy | None = None
) -> DataFrame:
    """Add ``_run, track_no``.  No track outlives a pause longer than the merge gap,
    so every video is cut there."""
    order = ["timestamp_ms", "observation_id"]
    scan = ordered(observed, ["video_id"], order, policy)
    paused = F.col("timestamp_ms") - F.col("_before") > params.max_merge_gap_ms
    rows = cut_at_pauses(scan, {"_before": ("last", F.col("timestamp_ms"))}, paused).done()
    return fold_rows(
        rows,
        ["video_id", RUN],
        order,
        ["timestamp_ms", "normalized_text", "bbox"],
        lambda: _TrackRule(params),
        "track_no",
        T.LongType(),
    )


def text_spans(tracked: DataFrame, params: OcrParams = OcrParams(), with_ids: bool = True) -> DataFrame:
    """One row per track seen often enough.

    ``with_ids=False`` leaves the id list out for tracks of unknown length; the
    membership is then the ``tracked`` table itself.
    """
    place = F.struct("timestamp_ms", "observation_id")
    clearest = F.struct((-F.col("confidence")).alias("c"), "timestamp_ms", "observation_id")
    aggregates = [
        F.min(place).alias("_first"),
        F.max("timestamp_ms").alias("_last_ms"),
        F.min_by("normalized_text", clearest).alias("text"),
        F.avg("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("occurrences"),
    ]
    if with_ids:
        aggregates.append(F.array_sort(F.collect_list(place)).alias("_members"))
    grouped = (
        tracked.groupBy("video_id", "_run", "track_no")
        .agg(*aggregates)
        .where(F.col("occurrences") >= params.min_span_occurrences)
    )
    columns = [
        "video_id",
        F.concat(F.lit("span_"), F.col("_first.observation_id")).alias("span_id"),
        F.col("_first.timestamp_ms").alias("start_ms"),
        (F.col("_last_ms") + 1).alias("end_ms"),
        "text",
        "confidence",
        "occurrences",
    ]
    if with_ids:
        columns.append(F.transform("_members", lambda m: m["observation_id"]).alias("observation_ids"))
    return grouped.select(*columns)
