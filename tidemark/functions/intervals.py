"""Half-open interval predicates and arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def overlaps(a_start: ColumnLike, a_end: ColumnLike, b_start: ColumnLike, b_end: ColumnLike) -> Column:
    """Touching intervals do not overlap."""
    return (_c(a_start) < _c(b_end)) & (_c(b_start) < _c(a_end))


def contains_timestamp(start: ColumnLike, end: ColumnLike, timestamp: ColumnLike) -> Column:
    return (_c(start) <= _c(timestamp)) & (_c(timestamp) < _c(end))


def contains_range(a_start: ColumnLike, a_end: ColumnLike, b_start: ColumnLike, b_end: ColumnLike) -> Column:
    return (_c(a_start) <= _c(b_start)) & (_c(b_end) <= _c(a_end))


def intersection(a_start: ColumnLike, a_end: ColumnLike, b_start: ColumnLike, b_end: ColumnLike) -> Column:
    """``struct(start_ms, end_ms)``, NULL when the intervals do not overlap."""
    start = F.greatest(_c(a_start), _c(b_start))
    end = F.least(_c(a_end), _c(b_end))
    return F.when(start < end, F.struct(start.alias("start_ms"), end.alias("end_ms")))


def duration_ms(start: ColumnLike, end: ColumnLike) -> Column:
    return _c(end) - _c(start)


def map_timeline(
    timestamp: ColumnLike, from_start: ColumnLike, from_end: ColumnLike, to_start: ColumnLike
) -> Column:
    """Move a timestamp from one clip timeline to another of the same length.

    NULL outside ``[from_start, from_end)``; :func:`map_timeline_strict` raises.
    """
    inside = contains_timestamp(from_start, from_end, timestamp)
    return F.when(inside, _c(to_start) + _c(timestamp) - _c(from_start))


def map_timeline_strict(
    timestamp: ColumnLike, from_start: ColumnLike, from_end: ColumnLike, to_start: ColumnLike
) -> Column:
    mapped = map_timeline(timestamp, from_start, from_end, to_start)
    return F.coalesce(mapped, F.raise_error(F.lit("timestamp is outside the mapped range")))
