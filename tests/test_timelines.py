"""Ordered scans, interval joins and range operators against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clips, ranges
from tidemark.plans.ordered import numbered, ordered, running
from tidemark.plans.overlap import overlap_join, overlap_semi, point_in_interval_join

SCHEMA = "video_id long, start_ms long, end_ms long, rid long"


def random_rows(seed: int, count: int = 160):
    rng = random.Random(seed)
    rows = []
    for rid in range(count):
        # video 1 holds most rows; a few lengths repeat so that ends touch
        video = 1 if rng.random() < 0.7 else rng.choice([2, 3])
        start = rng.randrange(0, 6_000)
        rows.append((video, start, start + rng.choice([1, 2, 16, 17, 90, 1_500]), rid))
    return rows


def merge(pairs, gap=0):
    merged = []
    for start, end in sorted(pairs):
        if merged and start <= merged[-1][1] + gap:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [tuple(m) for m in merged]


def by_video(rows):
    grouped = {}
    for video, start, end, *_ in rows:
        grouped.setdefault(video, []).append((start, end))
    return grouped


def as_set(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


@pytest.fixture(params=[None, "cut"])
def policy(request, cut_policy):
    return cut_policy if request.param else None


@pytest.mark.parametrize("gap", [0, 25])
def test_merge_ranges(spark, policy, gap):
    rows = random_rows(1)
    got = as_set(ranges.merge_ranges(spark.createDataFrame(rows, SCHEMA), merge_gap_ms=gap, policy=policy), "video_id", "start_ms", "end_ms")
    assert got == sorted((v, *m) for v, pairs in by_video(rows).items() for m in merge(pairs, gap))


def test_merging_twice_changes_nothing(spark):
    once = ranges.merge_ranges(spark.createDataFrame(random_rows(2), SCHEMA)).select("video_id", "start_ms", "end_ms")
    assert as_set(ranges.merge_ranges(once), "video_id", "start_ms", "end_ms") == as_set(once, "video_id", "start_ms", "end_ms")


def test_running_aggregates_cross_shards(spark, cut_policy):
    rows = random_rows(3)
    df = spark.createDataFrame(rows, SCHEMA)
    scan = ordered(df, ["video_id"], ["start_ms", "rid"], cut_policy)
    scan = running(scan, {"total": ("sum", F.col("end_ms")), "top": ("max", F.col("end_ms"))})
    scan = running(scan, {"before": ("last", F.col("rid"))}, inclusive=False)
    got = {row.rid: row for row in numbered(scan, "pos").done().collect()}
    for video in {r[0] for r in rows}:
        total, top, before = 0, 0, None
        for position, row in enumerate(sorted((r for r in rows if r[0] == video), key=lambda r: (r[1], r[3]))):
            total, top = total + row[2], max(top, row[2])
            found = got[row[3]]
            assert (found.total, found.top, found.before, found.pos) == (total, top, before, position)
            before = row[3]


def test_gaps_and_coverage_partition_the_total(spark, policy):
    rows = random_rows(4)
    covered = spark.createDataFrame(rows, SCHEMA)
    totals = spark.createDataFrame([(v, 500, 5_000) for v in (1, 2, 3, 4)], "video_id long, total_start_ms long, total_end_ms long")
    got = as_set(ranges.unseen_ranges(covered, totals, policy=policy), "video_id", "start_ms", "end_ms")
    for video in (1, 2, 3, 4):
        taken = set()
        for start, end in by_video(rows).get(video, []):
            taken.update(range(max(500, start), min(5_000, end)))
        free = {t for v, s, e in got if v == video for t in range(s, e)}
        assert free == set(range(500, 5_000)) - taken
    assert (4, 500, 5_000) in got


def test_subtract_ranges(spark, policy):
    items, known = random_rows(5, 40), random_rows(6, 60)
    got = as_set(
        ranges.subtract_ranges(spark.createDataFrame(items, SCHEMA), spark.createDataFrame(known, SCHEMA), policy=policy),
        "rid", "start_ms", "end_ms",
    )
    expected = []
    for video, start, end, rid in items:
        cursor = start
        for k_start, k_end in merge(by_video(known).get(video, [])):
            if k_start < end and start < k_end:
                if cursor < k_start:
                    expected.append((rid, cursor, k_start))
                cursor = max(cursor, k_end)
        if cursor < end:
            expected.append((rid, cursor, end))
    assert got == sorted(expected)


def test_new_coverage_is_measured_before_the_call(spark):
    added = spark.createDataFrame([(1, 0, 10, 0), (1, 5, 20, 1)], SCHEMA)
    known = spark.createDataFrame([(1, 8, 12, 0)], SCHEMA)
    assert as_set(ranges.newly_covered(added, known), "start_ms", "end_ms") == [(0, 8), (12, 20)]


def test_coverage_ratio(spark):
    covered = spark.createDataFrame([(1, 0, 10, 0), (1, 5, 20, 1), (2, 0, 50, 2), (3, 0, 5, 3)], SCHEMA)
    totals = spark.createDataFrame([(1, 40), (2, 10), (3, 0), (4, 10)], "video_id long, duration_ms long")
    got = {r.video_id: (r.covered_ms, r.coverage or 0.0) for r in ranges.coverage_ratio(covered, totals).collect()}
    assert got == {1: (20, 0.5), 2: (50, 1.0), 3: (5, 0.0), 4: (0, 0.0)}


@pytest.fixture
def two_sides(spark):
    left, right = random_rows(7, 90), random_rows(8, 90)
    right_df = spark.createDataFrame(right, "video_id long, r_start_ms long, r_end_ms long, other long")
    return left, right, spark.createDataFrame(left, SCHEMA), right_df


def test_overlap_join(two_sides):
    left, right, left_df, right_df = two_sides
    got = as_set(overlap_join(left_df, right_df), "rid", "other")
    assert got == sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])


def test_overlap_semi_and_anti(two_sides, policy):
    left, right, left_df, right_df = two_sides
    hit = {a[3] for a in left for b in right if a[0] == b[0] and a[1] < b[2] and b[1] < a[2]}
    names = ("r_start_ms", "r_end_ms")
    semi = overlap_semi(left_df, right_df, right_range=names, policy=policy)
    anti = overlap_semi(left_df, right_df, right_range=names, anti=True, policy=policy)
    assert {r.rid for r in semi.collect()} == hit
    assert {r.rid for r in anti.collect()} == {a[3] for a in left} - hit


def test_point_in_interval(two_sides):
    left, right, left_df, right_df = two_sides
    points = left_df.select("video_id", "rid", F.col("start_ms").alias("at"))
    got = as_set(point_in_interval_join(points, right_df, ["video_id"], "at", "r_start_ms", "r_end_ms"), "rid", "other")
    assert got == sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and b[1] <= a[1] < b[2])


def test_touching_ranges_merge_but_do_not_overlap(spark):
    a = spark.createDataFrame([(1, 1_000, 2_000, 0)], SCHEMA)
    b = spark.createDataFrame([(1, 2_000, 3_000, 1)], SCHEMA)
    assert overlap_semi(a, b).count() == 0
    assert as_set(ranges.merge_ranges(a.union(b)), "start_ms", "end_ms") == [(1_000, 3_000)]


def test_clips_follow_context_windows_and_limits(spark):
    evidence = spark.createDataFrame(
        [("v", "e1", 1_000, 2_000), ("v", "e2", 30_000, 31_000), ("v", "e3", 90_000, 91_000)],
        "video_id string, evidence_id string, start_ms long, end_ms long",
    )
    contexts = spark.createDataFrame(
        [("v", "c1", [(0, 4_000), (6_000, 7_000)], ["e1", "other"])],
        "video_id string, context_id string, ranges array<struct<start_ms:long,end_ms:long>>, evidence_ids array<string>",
    )
    durations = spark.createDataFrame([("v", 91_500)], "video_id string, duration_ms long")
    chosen = clips.clip_selections(evidence, durations, contexts, 0, 1_000)
    merged = clips.merged_clips(clips.clip_members(chosen))
    assert as_set(merged, "start_ms", "end_ms", "n_evidence") == [(0, 8_000, 1), (30_000, 32_000, 1), (90_000, 91_500, 1)]
    assert clips.clip_limit_errors(merged, padding_before_ms=0, padding_after_ms=1_000).first().error is None
    assert "padding" in clips.clip_limit_errors(merged, padding_before_ms=6_000).first().error
    tight = clips.ClipPolicy(max_clips=2)
    assert "At most 2" in clips.clip_limit_errors(merged, tight).first().error
