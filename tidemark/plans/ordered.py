"""Running aggregates along a timeline that stay parallel however long one timeline is.

A plain ``Window.partitionBy(video_id)`` puts a whole timeline into one task.  Here
every timeline is cut into shards by the value it is ordered by: a shard covers
``ScanPolicy.span`` units of the first order column (an hour of milliseconds by
default).  The window runs per shard, and a carry from the earlier shards of the
timeline is joined in.  Shards follow from the data alone, so there is one plan for
every size, nothing is counted or sampled, and reruns agree.  The carry has one row
per shard of timelines that have several.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

SHARD = "_shard"
_BEFORE_ALL = -(1 << 62)


@dataclass(frozen=True)
class ScanPolicy:
    """How much of the first order column a shard covers.

    Milliseconds where that column is a time (timestamps count as such), positions or
    plain values otherwise.  It shapes the plan only; results do not depend on it.
    """

    span: float = 3_600_000.0


DEFAULT_POLICY = ScanPolicy()


@dataclass(frozen=True)
class OrderedFrame:
    """Rows with a total order inside each key, labelled with their shard."""

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    def with_frame(self, frame: DataFrame) -> "OrderedFrame":
        return OrderedFrame(frame, self.keys, self.order)

    @property
    def window(self):
        return Window.partitionBy(*self.keys, SHARD).orderBy(*self.order)

    def done(self) -> DataFrame:
        return self.frame.drop(SHARD)


def ordered(
    df: DataFrame,
    keys: tuple[str, ...] | list[str],
    order: tuple[str, ...] | list[str],
    policy: ScanPolicy | None = None,
) -> OrderedFrame:
    """Prepare ``df`` for :func:`running`; the first order column has to be a number or a time.

    Nulls and NaN of that column form shards of their own at either end, as sorting has them.
    The rows are stored once: every running aggregate reads them twice, for its rows and for
    the totals of its shards, and chains of them would multiply what comes before.
    """
    kind = df.schema[order[0]].dataType
    if not isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{order[0]} is neither a number nor a time")
    place = F.col(order[0])
    if not isinstance(kind, T.NumericType):
        place = place.cast("timestamp").cast("double") * 1000
    place = place.cast("double")
    limit = float(1 << 61)
    shard = F.floor(F.least(F.greatest(place / (policy or DEFAULT_POLICY).span, F.lit(-limit)), F.lit(limit))).cast("bigint")
    shard = F.when(place.isNull(), F.lit(_BEFORE_ALL)).when(F.isnan(place), F.lit(-_BEFORE_ALL)).otherwise(shard)
    return OrderedFrame(cut_lineage(df.withColumn(SHARD, shard)), tuple(keys), tuple(order))


def running(
    scan: OrderedFrame,
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> OrderedFrame:
    """Add running aggregates.

    ``specs`` maps a new column to ``(kind, expression)``; kinds are ``sum``,
    ``max`` and ``last`` (latest non-null value).  ``inclusive=False`` leaves the
    current row out, so ``last`` is then the previous value.
    """
    upper = 0 if inclusive else -1
    span = scan.window.rowsBetween(Window.unboundedPreceding, upper)
    local = {
        name: _window_aggregate(kind, expression).over(span)
        for name, (kind, expression) in specs.items()
    }
    position = F.struct(*[F.col(c) for c in scan.order])
    summaries = scan.frame.groupBy(*scan.keys, SHARD).agg(
        *[
            _summary_aggregate(kind, expression, position).alias(f"_c_{name}")
            for name, (kind, expression) in specs.items()
        ]
    )
    before = Window.partitionBy(*scan.keys).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    place = [*scan.keys, SHARD]
    carried = summaries.select(
        *[F.col(c).alias(f"_k_{c}") for c in place],
        F.row_number().over(Window.partitionBy(*scan.keys).orderBy(SHARD)).alias("_part"),
        *[
            _carry_aggregate(kind, F.col(f"_c_{name}")).over(before).alias(f"_c_{name}")
            for name, (kind, _) in specs.items()
        ],
    ).where("_part > 1")
    same = F.lit(True)
    for c in place:
        same = same & (F.col(c) == F.col(f"_k_{c}"))
    joined = scan.frame.withColumns(local).join(carried, same, "left")
    combined = {
        name: _combine(kind, F.col(f"_c_{name}"), F.col(name)) for name, (kind, _) in specs.items()
    }
    frame = joined.withColumns(combined).drop("_part", *[f"_k_{c}" for c in place], *[f"_c_{name}" for name in specs])
    return scan.with_frame(frame)


def numbered(scan: OrderedFrame, name: str = "ord") -> OrderedFrame:
    """Position of each row inside its key, from 0."""
    counted = running(scan, {name: ("sum", F.lit(1).cast("bigint"))})
    return counted.with_frame(counted.frame.withColumn(name, F.col(name) - 1))


def _window_aggregate(kind: str, expression: Column) -> Column:
    if kind == "sum":
        return F.sum(expression)
    if kind == "max":
        return F.max(expression)
    if kind == "last":
        return F.last(expression, ignorenulls=True)
    raise ValueError(f"unknown running aggregate: {kind}")


def _summary_aggregate(kind: str, expression: Column, position: Column) -> Column:
    if kind == "last":
        return F.max_by(expression, F.when(expression.isNotNull(), position))
    return _window_aggregate(kind, expression)


def _carry_aggregate(kind: str, summary: Column) -> Column:
    return _window_aggregate(kind, summary)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "max":
        return F.greatest(carry, local)
    return F.coalesce(local, carry)
