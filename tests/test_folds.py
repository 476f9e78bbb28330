"""Folds of stretches that cover many shards: the same breaks as one walk over all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunking
from tidemark.plans import folds
from tidemark.plans.ordered import ScanPolicy, ordered

ROWS = "k string, ord long, start long, stop long"


class Sum:
    """A group holds rows while its hull fits the limit and a third number has not passed."""

    def __init__(self, limit):
        self.limit, self.low = limit, 0

    def __call__(self, row, fresh):
        start, stop = row
        starts = fresh or stop - self.low > self.limit
        if starts:
            self.low = start
        return starts

    def state(self):
        return [self.low]

    def resume(self, state):
        (self.low,) = state


def walked(rows, limit):
    out, low, group, key = {}, None, -1, None
    for k, n, start, stop in sorted(rows):
        if k != key or stop - low > limit:
            group, low, key = (0 if k != key else group + 1), start, k
        out[k, n] = group
    return out


def folded(spark, rows, limit, span, specs=None):
    scan = ordered(spark.createDataFrame(rows, ROWS).repartition(4), ["k"], ["ord"], ScanPolicy(span=span))
    got = folds.fold_groups(scan, {"_reach": ("max", F.col("stop"))}, F.col("start") > F.col("_reach") + 1_000, ["start", "stop"], lambda: Sum(limit), "g", folds.Extent(0, 1, limit))
    return {(r.k, r.ord): r.g for r in got.collect()}


@pytest.mark.parametrize("span, limit", [(7, 35), (7, 400), (1, 55)])
def test_regular_series_never_fall_into_step(spark, span, limit):
    """Shards of 7 rows, groups of another number: a fold that starts with the shard never agrees."""
    rows = [(k, n, n * 10, n * 10 + 10) for k, size in (("a", 300), ("b", 40), ("c", 3)) for n in range(size)]
    assert folded(spark, rows, limit, span) == walked(rows, limit)


def test_random_series(spark):
    rng, rows, at = random.Random(6), [], 0
    for n in range(500):
        at += rng.choice([0, 1, 5, 60, 60, 1_500 if n % 90 == 0 else 7])
        rows.append(("a" if n % 7 else "b", n, at, at + rng.choice([1, 40, 300, 0])))
    assert folded(spark, rows, 200, 11) == walked(rows, 200)
    assert folded(spark, [], 200, 11) == {}


def test_jobs_do_not_grow_with_the_shards(spark):
    def jobs(shards):
        group = f"folds-{shards}"
        spark.sparkContext.setJobGroup(group, group)
        rows = [("a", n, n * 10, n * 10 + 10) for n in range(7 * shards)]
        assert folded(spark, rows, 45, 7) == walked(rows, 45)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(100) <= jobs(10) + 3


def test_no_task_folds_a_whole_stretch(spark, monkeypatch):
    """The rows a worker sees between two keys are those of one shard."""
    seen = []
    arranged = folds._arranged

    def spied(rows, states, piece, order):
        seen.append((list(piece), rows.groupBy(*piece).count().agg(F.max("count")).first()[0]))
        return arranged(rows, states, piece, order)

    monkeypatch.setattr(folds, "_arranged", spied)
    rows = [("a", n, n * 10, n * 10 + 10) for n in range(700)]
    assert folded(spark, rows, 45, 7) == walked(rows, 45)
    assert seen and all(size <= 24 and "_piece" in piece for piece, size in seen)


def test_chunks_of_continuous_speech(spark, cut_policy):
    """No silence at all: every shard of the video takes over what the one before left open."""
    rows = [("v", n, f"s{n}", n * 900, n * 900 + 900, "word " * (3 + n % 5) + ("." if n % 4 == 0 else "")) for n in range(200)]
    schema = "video_id string, ord long, segment_id string, start_ms long, end_ms long, normalized_text string"
    table = spark.createDataFrame(rows, schema)
    parts = {r.ord: r.chunk_no for r in chunking.assign_chunks(table, policy=cut_policy).collect()}
    whole = {r.ord: r.chunk_no for r in chunking.assign_chunks(table, policy=ScanPolicy(span=1e9)).collect()}
    assert parts == whole and max(parts.values()) > 10
