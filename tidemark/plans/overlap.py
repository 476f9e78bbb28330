"""Interval joins that never compare a whole timeline with itself.

Two intervals of one key overlap exactly when one starts inside the other:
either the left start lies in ``[right.start, right.end)`` or the right start
lies strictly inside the left interval.  Both halves are point-in-interval
joins, and they cannot match the same pair twice.

A point-in-interval join is made an equi-join with nested grids: an interval of
length d uses the grid whose cells are the smallest power of sixteen >= d, so it
touches at most two cells however long it is; a point looks up its cell in each
grid that holds intervals.  The list of grids in use is a scalar subquery of at
most 16 integers.  Hot cells are left to AQE's skew join, which may split them
because the join is a plain inner equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import ScanPolicy, ordered, running


_PLACE = ("_half", "_level", "_cell")


def _level(start: Column, end: Column) -> Column:
    """Smallest k with 16**k >= length."""
    length = (end - start).cast("bigint")
    bits = F.length(F.bin(F.greatest(length - 1, F.lit(0))))
    bits = F.when(length <= 1, F.lit(0)).otherwise(bits)
    return F.ceil(bits / F.lit(4)).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value.cast("bigint"), level * 4)


def point_in_interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str] | tuple[str, ...],
    point: str,
    start: str,
    end: str,
) -> DataFrame:
    """Pairs with ``start <= point < end``.

    Apart from ``keys`` the two sides must not share column names.
    """
    keys = list(keys)
    gridded = points.withColumn("_grids", _grids(intervals, start, end))
    looked_up = gridded.select(*points.columns, F.inline(_as_point(point, 0)))
    celled = intervals.select(*intervals.columns, F.inline(_as_interval(start, end, 0)))
    joined = looked_up.join(celled, [*keys, *_PLACE], "inner")
    return joined.where((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))).drop(*_PLACE)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | tuple[str, ...] = ("video_id",),
    left_range: tuple[str, str] = ("start_ms", "end_ms"),
    right_range: tuple[str, str] = ("r_start_ms", "r_end_ms"),
) -> DataFrame:
    """Every overlapping pair once; columns of both sides.

    Both halves run as one equi-join: each row carries its look-ups for half 0
    (left start in a right interval) and half 1 (right start in a left interval).
    """
    keys = list(keys)
    ls, le = left_range
    rs, re = right_range
    left_places = F.concat(_as_point(ls, 0), _as_interval(ls, le, 1))
    right_places = F.concat(_as_interval(rs, re, 0), _as_point(rs, 1))
    placed_left = left.withColumn("_grids", _grids(right, rs, re)).select(*left.columns, F.inline(left_places))
    placed_right = right.withColumn("_grids", _grids(left, ls, le)).select(*right.columns, F.inline(right_places))
    joined = placed_left.join(placed_right, [*keys, *_PLACE], "inner")
    inside = F.when(
        F.col("_half") == 0, (F.col(rs) <= F.col(ls)) & (F.col(ls) < F.col(re))
    ).otherwise((F.col(ls) < F.col(rs)) & (F.col(rs) < F.col(le)))
    return joined.where(inside).drop(*_PLACE)


def _grids(intervals: DataFrame, start: str, end: str) -> Column:
    levels = intervals.select(_level(F.col(start), F.col(end)).alias("_level"))
    return F.coalesce(
        levels.agg(F.array_sort(F.collect_set("_level"))).scalar(), F.array().cast("array<int>")
    )


def _place(half: int, level: Column, cell: Column) -> Column:
    return F.struct(F.lit(half).alias("_half"), level.alias("_level"), cell.alias("_cell"))


def _as_point(point: str, half: int) -> Column:
    return F.transform("_grids", lambda level: _place(half, level, _cell(F.col(point), level)))


def _as_interval(start: str, end: str, half: int) -> Column:
    level = _level(F.col(start), F.col(end))
    cells = F.sequence(_cell(F.col(start), level), _cell(F.col(end) - 1, level))
    return F.transform(cells, lambda cell: _place(half, level, cell))


def overlap_semi(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | tuple[str, ...] = ("video_id",),
    left_range: tuple[str, str] = ("start_ms", "end_ms"),
    right_range: tuple[str, str] = ("start_ms", "end_ms"),
    anti: bool = False,
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Left rows that overlap any right row, each once (``anti``: those that overlap none).

    No pairs are built.  A left row overlaps something exactly when the largest
    right end among right rows starting before the left end exceeds the left
    start, so one ordered scan over both sides decides it.
    """
    keys = list(keys)
    ls, le = left_range
    rs, re = right_range
    payload = F.struct(*[F.col(c) for c in left.columns if c not in keys])
    lefts = left.select(
        *keys,
        F.col(le).alias("_at"),
        F.lit(0).alias("_side"),
        F.lit(None).cast("bigint").alias("_reach"),
        payload.alias("_row"),
    )
    rights = right.select(
        *keys,
        F.col(rs).alias("_at"),
        F.lit(1).alias("_side"),
        F.col(re).cast("bigint").alias("_reach"),
        F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"),
    )
    scan = ordered(lefts.unionByName(rights), keys, ["_at", "_side"], policy)
    reached = running(scan, {"_reached": ("max", F.col("_reach"))}, inclusive=False).done()
    hit = F.coalesce(F.col("_reached") > F.col("_row")[ls], F.lit(False))
    kept = reached.where((F.col("_side") == 0) & (~hit if anti else hit))
    return kept.select(*keys, "_row.*").select(*left.columns)
