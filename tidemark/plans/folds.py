"""Sequential decisions along a timeline: break points that depend on earlier breaks.

Such folds are not window functions.  Rows are hash partitioned, sorted and streamed
through an Arrow iterator; a task holds the open group's few scalars and one Arrow
batch, never a timeline.

Every rule of this kind starts anew after a long enough pause, whatever it has seen
before.  Timelines are therefore cut at such pauses first (a running aggregate,
parallel for any size), and the stretches between them are folded independently.

A stretch without a pause that covers several shards is folded shard by shard, in
parallel, where the rule forgets everything at a break and its groups have a greatest
extent.  What a shard hands on is then the state of one of few groups, those that may be
open at its end.  All of them are found, every shard is folded from each state the one
before may hand on, and a walk over these few transitions picks the ones that apply.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.plans.ordered import SHARD, OrderedFrame, running
from tidemark.session import cut_lineage

# A rule keeps the open state.  ``rule(values, fresh)`` is called row by row and
# returns the row's output; ``fresh`` marks the first row of a run.
Rule = Callable[[tuple[Any, ...], bool], Any]

RUN = "_run"


def gathered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with all rows of one key in one partition.

    Dealt by a hash of the keys: a repartition by the keys themselves is taken for redundant
    after a join by them, and that join may at run time become a broadcast that leaves rows where they are.
    """
    return df.repartition(F.xxhash64(*keys))


def fold_rows(
    df: DataFrame,
    cluster: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    make_rule: Callable[[], Rule],
    output: str,
    output_type: T.DataType,
) -> DataFrame:
    """Add ``output``: what the rule returns for each row of a run, in order."""
    cluster, order, inputs = list(cluster), list(order), list(inputs)
    arranged = gathered(df, cluster).sortWithinPartitions(*cluster, *order)
    schema = T.StructType([*df.schema.fields, T.StructField(output, output_type)])
    arrow_type = to_arrow_type(output_type)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = make_rule()
        current: tuple[Any, ...] | None = None
        for batch in batches:
            keys = zip(*[batch.column(name).to_pylist() for name in cluster])
            rows = zip(*[batch.column(name).to_pylist() for name in inputs])
            results = []
            for key, row in zip(keys, rows):
                results.append(rule(row, key != current))
                current = key
            columns = [*batch.columns, pa.array(results, type=arrow_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, output])

    return arranged.mapInArrow(apply, schema)


def cut_at_pauses(scan: OrderedFrame, specs: dict[str, tuple[str, Column]], pause: Column) -> OrderedFrame:
    """Add ``_run``, the number of the row's stretch in its timeline.

    ``specs`` are running aggregates over the rows before (see ``running``);
    ``pause`` says from them whether a row starts a stretch.
    """
    before = running(scan, specs, inclusive=False)
    numbered = running(before, {RUN: ("sum", F.coalesce(pause, F.lit(False)).cast("bigint"))})
    return numbered.with_frame(numbered.frame.drop(*specs))


class Extent(NamedTuple):
    """Which inputs are a row's start and end, and how far a group of several rows reaches at most.

    Rows come by start.  A rule with an extent has ``state()`` and ``resume(state)``, and what
    it keeps after a break follows from that row alone.
    """

    start: int
    end: int
    limit: float


def fold_groups(
    scan: OrderedFrame,
    specs: dict[str, tuple[str, Column]],
    pause: Column,
    inputs: Sequence[str],
    make_rule: Callable[[], Rule],
    output: str = "group_no",
    extent: Extent | None = None,
) -> DataFrame:
    """Add ``output``: the number of the row's group inside its timeline, from 0.

    The rule returns True where a row starts a new group; ``pause`` must imply that.
    With an ``extent``, stretches of several shards are folded in parallel.
    """
    stretches = cut_at_pauses(scan, specs, pause)
    if extent is None:
        flagged = fold_rows(
            stretches.frame, [*scan.keys, RUN], scan.order, inputs, make_rule, "_starts", T.BooleanType()
        )
    else:
        flagged = _fold_shards(stretches, inputs, make_rule, extent)
    # stored, since the numbering reads it twice
    counted = running(scan.with_frame(cut_lineage(flagged.drop(RUN))), {output: ("sum", F.col("_starts").cast("bigint"))})
    return counted.done().withColumn(output, F.col(output) - 1).drop("_starts")


_STATE, _AFTER, _KIND, _PIECE = "_state", "_after", "_kind", "_piece"
_FRESH = "fresh"


def _fold_shards(stretches: OrderedFrame, inputs: Sequence[str], make_rule: Callable[[], Rule], extent: Extent) -> DataFrame:
    """The rows with ``_starts``; see the module's text for how stretches of several shards are folded."""
    place, order = [*stretches.keys, RUN], list(stretches.order)
    piece = [*place, _PIECE]
    along = Window.partitionBy(*place).orderBy(SHARD)
    # shards shorter than a few extents are folded together, so that no group lasts through a whole piece
    shards = stretches.frame.groupBy(*place, SHARD).agg(F.min(inputs[extent.start]).alias("_low"))
    number = F.floor(F.max("_low").over(along) / (4 * max(extent.limit, 1))).cast("bigint")
    rows = stretches.frame.join(shards.select(*place, SHARD, number.alias(_PIECE)), [*place, SHARD], "left")
    rows = cut_lineage(rows.withColumn(_PIECE, F.coalesce(_PIECE, F.lit(0).cast("bigint"))))
    narrow = rows.select(*dict.fromkeys([*piece, *order, *inputs]))
    along = Window.partitionBy(*place).orderBy(_PIECE)
    pieces = rows.select(*piece).groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"))
    pieces = cut_lineage(pieces.select(*piece, F.lag(_PIECE).over(along).alias("_before"), F.lead(_PIECE).over(along).alias("_next")))
    several = pieces.where("_before is not null or _next is not null")
    fresh = pieces.where("_before is null").select(*piece, F.lit(_FRESH).alias(_STATE))
    if several.isEmpty():
        return _fold_from(rows, fresh, piece, order, inputs, make_rule).drop(_PIECE)
    long_rows = cut_lineage(narrow.join(several.select(*piece), piece, "left_semi"))
    handing = long_rows.join(pieces.where("_next is not null").select(*piece, "_next"), piece)
    open_states = _open_states(handing, piece, order, inputs, make_rule, extent)
    asked = open_states.unionByName(fresh.join(several.select(*piece), piece, "left_semi"))
    known = cut_lineage(_transitions(long_rows, asked, piece, order, inputs, make_rule))
    while True:
        walked = cut_lineage(_walk(known, several.select(*piece), place))
        # a group that lasts through a whole shard hands on a state that none of its own rows opened
        missing = cut_lineage(walked.where(~F.col("_met")).select(*piece, _STATE))
        if missing.isEmpty():
            break
        some = long_rows.join(missing.select(*piece), piece, "left_semi")
        known = cut_lineage(known.unionByName(_transitions(some, missing, piece, order, inputs, make_rule)))
    states = fresh.join(several.select(*piece), piece, "left_anti").unionByName(walked.select(*piece, _STATE))
    return _fold_from(rows, states, piece, order, inputs, make_rule).drop(_PIECE)


def _arranged(rows: DataFrame, states: DataFrame, piece: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every shard's rows in order, behind the states it is to be folded from."""
    both = rows.withColumns({_KIND: F.lit(1), _STATE: F.lit(None).cast("string")})
    first = states.select(*piece, _STATE, F.lit(0).alias(_KIND))
    return gathered(both.unionByName(first, allowMissingColumns=True), piece).sortWithinPartitions(*piece, _KIND, *order)


def _streamed(batch: pa.RecordBatch, piece: Sequence[str], inputs: Sequence[str]) -> Iterator[tuple]:
    """``(shard, kind, state, row)`` of a batch's rows."""
    column = lambda name: batch.column(name).to_pylist()
    yield from zip(zip(*[column(name) for name in piece]), column(_KIND), column(_STATE), zip(*[column(name) for name in inputs]))


def _resumed(make_rule: Callable[[], Rule], state: str) -> Rule:
    rule = make_rule()
    if state != _FRESH:
        rule.resume(json.loads(state))
    return rule


def _fold_from(
    rows: DataFrame, states: DataFrame, piece: Sequence[str], order: Sequence[str], inputs: Sequence[str], make_rule: Callable[[], Rule]
) -> DataFrame:
    """The rows with ``_starts``, each shard folded from its one state."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_starts", T.BooleanType())])
    names = rows.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, begins = make_rule(), True
        for batch in batches:
            starts, kept = [], []
            for _, kind, state, row in _streamed(batch, piece, inputs):
                kept.append(kind == 1)
                if kind == 0:
                    rule, begins = _resumed(make_rule, state), state == _FRESH
                    continue
                starts.append(bool(rule(row, begins)))
                begins = False
            out = batch.select(names).filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(starts, pa.bool_())], names=[*names, "_starts"])

    return _arranged(rows, states, piece, order).mapInArrow(apply, schema)


def _emitted(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema.names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, schema.types)], schema=schema)


def _open_states(
    rows: DataFrame, piece: Sequence[str], order: Sequence[str], inputs: Sequence[str], make_rule: Callable[[], Rule], extent: Extent
) -> DataFrame:
    """``(shard, state)``: for each shard, the states of all groups that may be open at the end of the one before.

    Such a group was opened by a row from which on everything fits the extent.
    """
    kept = [c for c in piece if c != _PIECE]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(_PIECE, T.LongType()), T.StructField(_STATE, T.StringType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    source = rows.withColumns({_KIND: F.lit(1), _STATE: F.col("_next").cast("string")})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, following, tail = None, None, deque()

        def found():
            held, states = list(tail), set()
            for at in range(len(held)):
                rule = make_rule()
                rule(held[at], True)
                if not any(rule(row, False) for row in held[at + 1 :]):
                    states.add(json.dumps(rule.state()))
            return [(*shard[:-1], int(following), state) for state in sorted(states)]

        for batch in batches:
            out = []
            for key, _, after, row in _streamed(batch, piece, inputs):
                if key != shard:
                    if shard is not None:
                        out.extend(found())
                    shard, following = key, after
                    tail.clear()
                while tail and row[extent.end] - tail[0][extent.start] > extent.limit:
                    tail.popleft()
                tail.append(row)
            yield _emitted(out, arrow)
        if shard is not None:
            yield _emitted(found(), arrow)

    return gathered(source, piece).sortWithinPartitions(*piece, *order).mapInArrow(apply, schema)


def _transitions(
    rows: DataFrame, states: DataFrame, piece: Sequence[str], order: Sequence[str], inputs: Sequence[str], make_rule: Callable[[], Rule]
) -> DataFrame:
    """``states`` with ``_after``: the state at the shard's end of a fold from this one.

    Folds that break at the same row are one from there on.
    """
    schema = T.StructType([*[rows.schema[c] for c in piece], T.StructField(_STATE, T.StringType()), T.StructField(_AFTER, T.StringType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, folds = None, []  # folds: (rule, states it stands for, whether it has seen no row yet)

        def ended():
            return [(*shard, state, json.dumps(rule.state())) for rule, merged, _ in folds for state in merged]

        for batch in batches:
            out = []
            for key, kind, state, row in _streamed(batch, piece, inputs):
                if key != shard:
                    if shard is not None:
                        out.extend(ended())
                    shard, folds = key, []
                if kind == 0:
                    folds.append((_resumed(make_rule, state), [state], state == _FRESH))
                    continue
                broken, others = None, []
                for rule, merged, begins in folds:
                    if not rule(row, begins):
                        others.append((rule, merged, False))
                    elif broken is None:
                        broken = (rule, merged, False)
                    else:
                        broken[1].extend(merged)
                folds = others if broken is None else [*others, broken]
            yield _emitted(out, arrow)
        if shard is not None:
            yield _emitted(ended(), arrow)

    return _arranged(rows, states, piece, order).mapInArrow(apply, schema)


def _walk(known: DataFrame, pieces: DataFrame, place: Sequence[str]) -> DataFrame:
    """``(shard, state, met)``: the state each shard is really folded from, up to the first that is not known."""
    schema = T.StructType([*[pieces.schema[c] for c in (*place, _PIECE)], T.StructField(_STATE, T.StringType()), T.StructField("_met", T.BooleanType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    piece = [*place, _PIECE]
    both = known.select(*piece, F.lit(0).alias(_KIND), _STATE, _AFTER).unionByName(
        pieces.select(*piece, F.lit(1).alias(_KIND), F.lit(None).cast("string").alias(_STATE), F.lit(None).cast("string").alias(_AFTER))
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, state, after = None, None, {}
        for batch in batches:
            out = []
            for key, kind, before, (then,) in _streamed(batch, piece, [_AFTER]):
                if key[:-1] != stretch:
                    stretch, state, after = key[:-1], _FRESH, {}
                if kind == 0:
                    after[before] = then
                elif state is not None:
                    out.append((*key, state, state in after))
                    state, after = after.get(state), {}
                else:
                    after = {}
            yield _emitted(out, arrow)

    return gathered(both, place).sortWithinPartitions(*piece, _KIND).mapInArrow(apply, schema)
