"""Session ledgers over a whole event table: novelty, streaks, budgets, usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import merge_ranges
from tidemark.plans.ordered import ScanPolicy, ordered, running

# The usage counters and the budget shares that trigger one warning each.
USAGE_COUNTERS = (
    "wall_time_ms", "input_items", "output_items", "processed_duration_ms",
    "decoded_frames", "returned_frames", "model_calls", "input_tokens", "output_tokens",
)
BUDGET_THRESHOLDS = (0.5, 0.75, 0.9)


def split_new_and_reused(hits: DataFrame, top_k: int, policy: ScanPolicy | None = None) -> DataFrame:
    """Label hits ``new`` or ``reused`` and keep at most ``top_k`` of each per call.

    ``hits``: ``run_id, call_no, rank, candidate_id``.  A candidate is new in the
    first call (and rank) of its run that returns it; a new one beyond ``top_k``
    counts as reused.  First sightings are found with an aggregate, so a
    candidate seen everywhere costs one row per map task.
    """
    place = F.struct("call_no", "rank")
    first = hits.groupBy("run_id", "candidate_id").agg(F.min(place).alias("_first"))
    marked = hits.join(first, ["run_id", "candidate_id"]).withColumn("_fresh", F.col("_first") == place)
    keys, order = ["run_id", "call_no"], ["rank", "candidate_id"]
    scan = running(ordered(marked, keys, order, policy), {"_n": ("sum", F.col("_fresh").cast("bigint"))})
    new = F.col("_fresh") & (F.col("_n") <= top_k)
    scan = running(scan.with_frame(scan.frame.withColumn("_new", new)), {"_rest": ("sum", (~F.col("_new")).cast("bigint"))})
    return (
        scan.done()
        .where(F.col("_new") | (F.col("_rest") <= top_k))
        .select(
            "run_id",
            "call_no",
            "rank",
            "candidate_id",
            F.when(F.col("_new"), "new").otherwise("reused").alias("status"),
        )
    )


def overfetch(top_k: int, factor: int = 3, limit: int = 50) -> int:
    """How many hits a tool asks for so that enough new ones remain."""
    if factor <= 0:
        raise ValueError("factor must be positive")
    return min(limit, max(top_k, top_k * factor))


def no_gain_streaks(
    calls: DataFrame,
    keys: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("call_no",),
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Add ``streak`` (consecutive calls without gain, this one included) and ``replan``.

    The streak is the distance to the latest gaining call: two running
    aggregates, which stay parallel for a run of any length.
    """
    scan = running(ordered(calls, list(keys), list(order), policy), {"_pos": ("sum", F.lit(1).cast("bigint"))})
    scan = running(scan, {"_gain_at": ("max", F.when(F.col("gained"), F.col("_pos")))})
    return scan.done().withColumn("streak", F.col("_pos") - F.coalesce("_gain_at", F.lit(0))).withColumn(
        "replan", F.col("streak") >= 2
    ).drop("_pos", "_gain_at")


def budget_warnings(
    calls: DataFrame,
    max_total: int,
    keys: Sequence[str] = ("run_id",),
    order: Sequence[str] = ("call_no",),
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """The call at which each budget share is first reached; ``tokens`` is the call's spend."""
    scan = running(ordered(calls, list(keys), list(order), policy), {"spent": ("sum", F.col("tokens"))})
    share = F.col("spent") / F.lit(max_total)
    before = (F.col("spent") - F.col("tokens")) / F.lit(max_total)
    thresholds = F.array(*[F.lit(t) for t in BUDGET_THRESHOLDS])
    return (
        scan.done()
        .withColumn("threshold", F.explode(F.filter(thresholds, lambda t: (share >= t) & (before < t))))
        .select(*keys, *order, "spent", "threshold")
    )


def usage_rollup(usage: DataFrame, keys: Sequence[str]) -> DataFrame:
    present = [c for c in USAGE_COUNTERS if c in usage.columns]
    return usage.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in present])


def latest(events: DataFrame, count: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last ``count`` rows per key; map tasks already drop all but ``count``."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_back", F.row_number().over(window)).where(F.col("_back") <= count).drop("_back")


def latest_by_id(items: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per id: the last one wins, its position is the first sighting's."""
    place = F.struct(*order)
    payload = F.struct(*[c for c in items.columns if c not in keys])
    return (
        items.groupBy(*keys)
        .agg(F.max_by(payload, place).alias("_row"), F.min(place).alias("first_seen"))
        .select(*keys, "_row.*", "first_seen")
    )


def evidence_bundle_ranges(evidence: DataFrame, policy: ScanPolicy | None = None) -> DataFrame:
    """Covered ranges of each run's evidence."""
    return merge_ranges(evidence, ["run_id"], policy=policy)


def covering_manifests(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Newest frame manifest holding every wanted frame of a request (division).

    ``frames``: ``video_id, manifest_no, frame_id``; ``wanted``: ``request_id,
    video_id, frame_id``.  Manifests with the same frames, and requests for the
    same frames, are first reduced to one row each (a manifest holds a bounded
    number of frames).  A request then meets only the manifests that hold its
    rarest frame.
    """
    def frame_set(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("frame_id")).alias("frames"))

    manifests = (
        frame_set(frames, "video_id", "manifest_no")
        .groupBy("video_id", "frames")
        .agg(F.max("manifest_no").alias("manifest_no"))
        .withColumnRenamed("frames", "held")
    )
    asked = frame_set(wanted, "request_id", "video_id")
    asks = asked.select("video_id", "frames").distinct()
    holders = manifests.withColumn("frame_id", F.explode("held"))
    spread = holders.groupBy("video_id", "frame_id").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        asks.withColumn("frame_id", F.explode("frames"))
        .join(spread, ["video_id", "frame_id"])
        .groupBy("video_id", "frames")
        .agg(F.min_by("frame_id", F.struct("n", "frame_id")).alias("frame_id"))
    )
    answers = (
        rarest.join(holders, ["video_id", "frame_id"])
        .where(F.size(F.array_except("frames", "held")) == 0)
        .groupBy("video_id", "frames")
        .agg(F.max("manifest_no").alias("manifest_no"))
    )
    return asked.join(answers, ["video_id", "frames"]).select("request_id", "video_id", "manifest_no")


def resolve_targets(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of target lists in priority order; for an exact range the first one stays.

    Each part: ``video_id, target_id, start_ms, end_ms, chunk_id, pos``.
    """
    union = None
    for priority, part in enumerate(parts):
        tagged = part.withColumn("_priority", F.lit(priority))
        union = tagged if union is None else union.unionByName(tagged)
    if union is None:
        raise ValueError("no target lists given")
    return (
        union.groupBy("video_id", "start_ms", "end_ms")
        .agg(F.min_by(F.struct("target_id", "chunk_id"), F.struct("_priority", "pos", "target_id")).alias("_t"))
        .select("video_id", "_t.target_id", "start_ms", "end_ms", "_t.chunk_id")
    )
