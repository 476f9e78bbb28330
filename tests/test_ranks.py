"""Runs of ranks against all pairs, and artifacts of hits on small cases."""

from __future__ import annotations

import random

import pytest

from tidemark.operators import artifacts, indexing
from tidemark.plans.ranks import expanded, overlapping_spans, rank_ranges, ranked

ITEMS = "video_id string, item_id long, start_ms long, end_ms long"
SPANS = "video_id string, ord long, chunk_id string, start_ms long, end_ms long"


def make(rng, videos=("a", "b", "c")):
    spans, items = [], []
    for video in videos:
        at = 0
        for n in range(40):
            at += rng.choice([0, 0, 3, 20])
            end = at + rng.choice([1, 5, 30])
            spans.append((video, n, f"{video}{n}", at, end))
            at = end
        for n in range(60):
            start = rng.randrange(-20, at + 20)
            items.append((video, n, start, start + rng.choice([0, 1, 7, 400])))
    return spans, items


@pytest.mark.parametrize("cut", [False, True])
def test_runs_are_what_pairs_would_give(spark, cut_policy, cut):
    spans, items = make(random.Random(2))
    items += [("nowhere", 1, 0, 5), ("a", 900, 5, 5)]
    policy = cut_policy if cut else None
    table, others = spark.createDataFrame(spans, SPANS), spark.createDataFrame(items, ITEMS)
    found = rank_ranges(others, table, policy=policy)
    expected = {}
    for video, n, start, end in items:
        ranks = [s[1] for s in spans if s[0] == video and s[3] < end and start < s[4]]
        expected[video, n] = (min(ranks), max(ranks), len(ranks)) if ranks else (None, None, 0)
    assert {(r.video_id, r.item_id): (r.first_rank, r.last_rank, r.n_spans) for r in found.collect()} == expected
    long = expanded(found, ranked(table, policy=policy)).collect()
    assert len(long) == sum(n for *_, n in expected.values())
    assert all(r.rank == r.ord for r in long)
    assert overlapping_spans(table, policy=policy).count() == 0


def test_ids_by_runs_and_by_pairs_agree(spark):
    spans, items = make(random.Random(3))
    table, others = spark.createDataFrame(spans, SPANS), spark.createDataFrame([i for i in items if i[2] < i[3]], ITEMS)
    rows = lambda disjoint: sorted((r.video_id, r.item_id, r.ids) for r in indexing.overlapping_ids(others, table, "chunk_id", "ids", disjoint=disjoint).collect())
    assert rows(True) == rows(False)


def test_spans_that_overlap_or_are_empty_are_named(spark):
    rows = [("a", 0, "x", 0, 10), ("a", 1, "y", 9, 12), ("a", 2, "z", 12, 12), ("b", 0, "w", 0, 3)]
    assert sorted(r.chunk_id for r in overlapping_spans(spark.createDataFrame(rows, SPANS)).collect()) == ["y", "z"]


HITS = "video_id string, modality string, rank int, source_ids array<string>"
FRAMES = "video_id string, frame_id string, artifact_id string, uri string"


def test_pictures_keep_their_first_place_and_their_last_name(spark):
    frames = spark.createDataFrame([("v", "f1", "a1", "one"), ("v", "f2", "a2", "two"), ("v", "f3", "a1", "one again"), ("w", "f1", "a9", "other video")], FRAMES)
    sparse = spark.createDataFrame([("v", "ocr", 1, ["s", "f1", "nothing", "f2"]), ("v", "ocr", 2, ["t"]), ("v", "speech", 3, ["s", "f2"])], HITS)
    dense = spark.createDataFrame([("v", "ocr", 1, ["s", "f3", "f2"]), ("w", "ocr", 2, ["s", "f1"])], HITS)
    lists = [artifacts.hit_artifacts(hits, frames) for hits in (sparse, dense)]
    assert sorted((r.rank, r.position, r.artifact_id) for r in lists[0].collect()) == [(1, 1, "a1"), (1, 3, "a2"), (3, 1, "a2")]
    merged = artifacts.distinct_artifacts(lists)
    got = sorted((r.video_id, r.modality, r.source_id, r.place, r.artifact_id, r.uri) for r in merged.collect())
    assert got == [("v", "ocr", "s", 0, "a1", "one again"), ("v", "ocr", "s", 1, "a2", "two"), ("v", "speech", "s", 0, "a2", "two"), ("w", "ocr", "s", 0, "a9", "other video")]
    fused = spark.createDataFrame([("v", "ocr", "s", 1), ("v", "ocr", "t", 2)], "video_id string, modality string, source_id string, rank int")
    assert sorted((r.rank, r.place, r.uri) for r in artifacts.fused_artifacts(fused, merged).collect()) == [(1, 0, "one again"), (1, 1, "two")]
