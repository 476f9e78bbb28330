"""Range coalescing, complement, subtraction and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import ScanPolicy, ordered, running
from tidemark.plans.overlap import overlap_join


def label_islands(
    df: DataFrame,
    keys: Sequence[str] = ("video_id",),
    merge_gap_ms: int = 0,
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Add ``island_start``: the start of the merged range the row belongs to.

    Ranges merge when they overlap, touch, or are at most ``merge_gap_ms`` apart.
    """
    scan = ordered(df, list(keys), ["start_ms", "end_ms"], policy)
    scan = running(scan, {"_reach": ("max", F.col("end_ms"))}, inclusive=False)
    opens = F.col("_reach").isNull() | (F.col("start_ms") > F.col("_reach") + merge_gap_ms)
    scan = running(scan, {"island_start": ("max", F.when(opens, F.col("start_ms")))})
    return scan.done().drop("_reach")


def merge_ranges(
    df: DataFrame,
    keys: Sequence[str] = ("video_id",),
    merge_gap_ms: int = 0,
    aggregates: Sequence[Column] = (),
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Sorted union of ranges per key: ``start_ms, end_ms, n_ranges`` (+ ``aggregates``)."""
    keys = list(keys)
    if not aggregates:
        df = df.select(*keys, "start_ms", "end_ms")
    return (
        label_islands(df, keys, merge_gap_ms, policy)
        .groupBy(*keys, "island_start")
        .agg(
            F.max("end_ms").alias("end_ms"),
            F.count(F.lit(1)).alias("n_ranges"),
            *aggregates,
        )
        .withColumnRenamed("island_start", "start_ms")
    )


def unseen_ranges(
    covered: DataFrame,
    totals: DataFrame,
    keys: Sequence[str] = ("video_id",),
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Parts of each key's total range (``total_start_ms, total_end_ms``) nothing covers.

    ``covered`` need not be merged.  A zero-length marker at each total's end
    turns the tail gap, and the whole total of an uncovered key, into ordinary
    gaps, so one scan finds them all.
    """
    keys = list(keys)
    inside = (
        covered.select(*keys, "start_ms", "end_ms")
        .join(totals.select(*keys, "total_start_ms", "total_end_ms"), keys)
        .where("start_ms < total_end_ms AND total_start_ms < end_ms")
    )
    markers = totals.select(
        *keys,
        F.col("total_end_ms").alias("start_ms"),
        F.col("total_end_ms").alias("end_ms"),
        "total_start_ms",
        "total_end_ms",
    )
    scan = ordered(inside.unionByName(markers), keys, ["start_ms", "end_ms"], policy)
    scan = running(scan, {"_reach": ("max", F.col("end_ms"))}, inclusive=False)
    gap_start = F.greatest(F.col("_reach"), F.col("total_start_ms"))
    return (
        scan.done()
        .select(*keys, gap_start.alias("gap_start"), F.col("start_ms").alias("gap_end"))
        .where("gap_start < gap_end")
        .select(*keys, F.col("gap_start").alias("start_ms"), F.col("gap_end").alias("end_ms"))
    )


def subtract_ranges(
    items: DataFrame,
    known: DataFrame,
    keys: Sequence[str] = ("video_id",),
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Each item minus the known ranges of its key, one row per remaining piece.

    The complement of ``known`` is built once per key; the pieces are then the
    intersections of the items with it.  Item columns are kept, ``start_ms`` and
    ``end_ms`` become the piece.
    """
    keys = list(keys)
    hull = items.groupBy(*keys).agg(
        F.min("start_ms").alias("total_start_ms"), F.max("end_ms").alias("total_end_ms")
    )
    free = unseen_ranges(known, hull, keys, policy).select(
        *keys, F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms")
    )
    pieces = overlap_join(items, free, keys)
    return pieces.withColumns(
        {
            "start_ms": F.greatest("start_ms", "r_start_ms"),
            "end_ms": F.least("end_ms", "r_end_ms"),
        }
    ).select(*items.columns)


def newly_covered(
    added: DataFrame,
    known: DataFrame,
    keys: Sequence[str] = ("video_id",),
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Merged ranges that ``added`` brings beyond the coverage before the call."""
    return merge_ranges(subtract_ranges(added, known, keys, policy), keys, policy=policy)


def coverage_ratio(
    covered: DataFrame,
    totals: DataFrame,
    keys: Sequence[str] = ("video_id",),
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """``covered_ms`` and ``coverage`` per row of ``totals`` (``duration_ms``).

    Ranges are merged but not clipped; the ratio is capped at 1 and is 0 when the
    duration is unknown or not positive.
    """
    keys = list(keys)
    merged = merge_ranges(covered, keys, policy=policy)
    sums = merged.groupBy(*keys).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))
    ratio = F.when(
        F.coalesce(F.col("duration_ms"), F.lit(0)) > 0,
        F.least(F.lit(1.0), F.col("covered_ms") / F.col("duration_ms")),
    ).otherwise(F.lit(0.0))
    return (
        totals.join(sums, keys, "left")
        .withColumn("covered_ms", F.coalesce("covered_ms", F.lit(0)))
        .withColumn("coverage", ratio)
    )
