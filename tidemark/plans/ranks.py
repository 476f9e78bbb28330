"""Which spans an interval meets, as one run of their positions.

Spans of one key that do not overlap each other are ordered by start and by end alike.
Those that an interval overlaps are then neighbours in that order: the first is the number
of spans that end at or before the interval's start, the last the one before the first
that starts at or after its end.  Both are counts along the timeline, so one ordered scan
over spans and intervals answers all intervals without forming a pair; a list of
what is met is two numbers, and a long table only where someone asks for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import ScanPolicy, numbered, ordered, running


def rank_ranges(
    items: DataFrame,
    spans: DataFrame,
    item_key: Sequence[str] = ("item_id",),
    keys: Sequence[str] = ("video_id",),
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """``keys, item_key, first_rank, last_rank, n_spans`` of every item; ranks count spans by start, from 0.

    Items that meet nothing have ``n_spans = 0`` and null ranks.  Both tables have
    ``start_ms, end_ms``; spans must not overlap within a key (see :func:`overlapping_spans`)
    and must not be empty.
    """
    keys, item_key = list(keys), list(item_key)
    item = F.struct(*item_key)
    nobody = F.lit(None).cast(items.select(item.alias("i")).schema["i"].dataType)
    # at one place: spans end, items start, items end, spans start
    begins = items.select(*keys, F.col("start_ms").alias("_at"), F.lit(1).alias("_side"), item.alias("_item"))
    stops = items.select(*keys, F.col("end_ms").alias("_at"), F.lit(2).alias("_side"), item.alias("_item"))
    ends = spans.select(*keys, F.col("end_ms").alias("_at"), F.lit(0).alias("_side"), nobody.alias("_item"))
    starts = spans.select(*keys, F.col("start_ms").alias("_at"), F.lit(3).alias("_side"), nobody.alias("_item"))
    scan = ordered(ends.unionByName(begins).unionByName(stops).unionByName(starts), keys, ["_at", "_side"], policy)
    one = lambda side: F.when(F.col("_side") == side, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    counted = running(scan, {"_ended": ("sum", one(0)), "_started": ("sum", one(3))}).done().where("_item is not null")
    found = counted.groupBy(*keys, "_item").agg(
        F.max(F.when(F.col("_side") == 1, F.col("_ended"))).alias("_first"), (F.max(F.when(F.col("_side") == 2, F.col("_started"))) - 1).alias("_last")
    )
    met = F.col("_last") >= F.col("_first")
    return found.select(
        *keys,
        "_item.*",
        F.when(met, F.col("_first")).alias("first_rank"),
        F.when(met, F.col("_last")).alias("last_rank"),
        F.when(met, F.col("_last") - F.col("_first") + 1).otherwise(F.lit(0)).cast("bigint").alias("n_spans"),
    )


def ranked(spans: DataFrame, keys: Sequence[str] = ("video_id",), policy: ScanPolicy | None = None) -> DataFrame:
    """Spans with ``rank``, their position by start within the key, from 0."""
    return numbered(ordered(spans, list(keys), ["start_ms", "end_ms"], policy), "rank").done()


def expanded(found: DataFrame, ranked_spans: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """One row for each item and span of its run: an equi-join on key and rank."""
    long = found.where("n_spans > 0").withColumn("rank", F.explode(F.sequence("first_rank", "last_rank"))).drop("first_rank", "last_rank", "n_spans")
    return long.join(ranked_spans, [*keys, "rank"])


def overlapping_spans(spans: DataFrame, keys: Sequence[str] = ("video_id",), policy: ScanPolicy | None = None) -> DataFrame:
    """Spans that start before an earlier one has ended, or are empty: those rank ranges cannot be used with."""
    scan = ordered(spans, list(keys), ["start_ms", "end_ms"], policy)
    reached = running(scan, {"_reached": ("max", F.col("end_ms"))}, inclusive=False).done()
    return reached.where(F.coalesce(F.col("start_ms") < F.col("_reached"), F.lit(False)) | (F.col("start_ms") >= F.col("end_ms"))).drop("_reached")
