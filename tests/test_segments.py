"""Chunking, fusion, context, frames and on-screen text on the reference cases and brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import text_ratio
from tidemark.operators import chunking, context, frames, fusion, screen_text

SEGMENTS = "video_id string, ord long, segment_id string, start_ms long, end_ms long, normalized_text string"
SPANS = "video_id string, ord long, chunk_id string, start_ms long, end_ms long"
SHOTS = "video_id string, ord long, shot_id string, start_ms long, end_ms long"


def make_segments(seed, count=220):
    rng = random.Random(seed)
    rows, at = [], {"a": 0, "b": 0}
    for n in range(count):
        video = "a" if rng.random() < 0.85 else "b"
        at[video] += rng.choice([0, 50, 400, 2_500, 2_501, 4_000])
        start, end = at[video], at[video] + rng.choice([300, 1_500, 4_000])
        at[video] = rng.choice([end, end - 200])
        text = "x" * rng.choice([3, 20, 60]) + rng.choice(["", ".", "?\"", "。", ","])
        rows.append((video, n, f"s{n}", start, end, text))
    return rows


def expected_labels(rows, p):
    labels = {}
    for video in {r[0] for r in rows}:
        group, number = [], 0
        for row in sorted((r for r in rows if r[0] == video), key=lambda r: r[1]):
            if group:
                chars = sum(len(g[5]) for g in group) + len(row[5])
                if (max(0, row[3] - group[-1][4]) > p.max_silence_gap_ms or chars > p.max_characters
                        or row[4] - group[0][3] > p.max_duration_ms):
                    group, number = [], number + 1
            group.append(row)
            labels[row[1]] = number
            chars, span = sum(len(g[5]) for g in group), group[-1][4] - group[0][3]
            if (chars >= p.target_characters or span >= p.target_duration_ms) and re.search("[.!?。！？；;][\"'”’）)]?$", row[5]):
                group, number = [], number + 1
    return labels


@pytest.mark.parametrize("cut", [False, True])
@pytest.mark.parametrize("params", [chunking.ChunkParams(), chunking.ChunkParams(target_characters=80, max_characters=150)])
def test_chunk_labels(spark, cut_policy, params, cut):
    rows = make_segments(11)
    df = spark.createDataFrame(rows, SEGMENTS)
    got = {r.ord: r.chunk_no for r in chunking.assign_chunks(df, params, cut_policy if cut else None).collect()}
    assert got == expected_labels(rows, params)


def test_two_sentences_make_two_chunks_with_shot_aligned_inspection(spark):
    rows = [("v", 0, "s1", 1_000, 4_000, "First sentence."), ("v", 1, "s2", 4_200, 7_000, "Second sentence.")]
    shots = spark.createDataFrame([("v", 0, "h0", 0, 8_000), ("v", 1, "h1", 8_000, 18_000), ("v", 2, "h2", 18_000, 30_000)], SHOTS)
    sources = spark.createDataFrame([("v", 0, 30_000)], "video_id string, source_start_ms long, source_end_ms long")
    params = chunking.ChunkParams(target_characters=10, max_characters=100)
    chunks = chunking.with_inspection(chunking.build_chunks(spark.createDataFrame(rows, SEGMENTS), params, sources), shots, params)
    got = chunks.orderBy("ord").collect()
    assert [(r.start_ms, r.end_ms, r.segment_ids, r.text) for r in got] == [
        (1_000, 4_000, ["s1"], "First sentence."), (4_200, 7_000, ["s2"], "Second sentence.")]
    assert (got[0].insp_start_ms, got[0].insp_end_ms, got[0].shot_ids) == (0, 8_000, ["h0"])


def test_shots_without_transcript_become_chunks(spark):
    shots = spark.createDataFrame([("v", 0, "h0", 0, 8_000), ("v", 1, "h1", 8_000, 18_000), ("v", 2, "h2", 18_000, 30_000)], SHOTS)
    sources = spark.createDataFrame([("v", 0, 30_000)], "video_id string, source_start_ms long, source_end_ms long")
    got = chunking.shot_fallback_chunks(shots, sources).orderBy("shot_ord").collect()
    assert [(r.start_ms, r.end_ms, r.basis) for r in got] == [(0, 8_000, "shot_fallback"), (8_000, 18_000, "shot_fallback"), (18_000, 30_000, "shot_fallback")]


def test_fusion_of_three_modalities(spark):
    hits = spark.createDataFrame(
        [("v", 0, 1, "transcript", ["t1"], 1_000, 2_000, "a"), ("v", 1, 1, "ocr", ["o1"], 2_500, 3_000, "b"),
         ("v", 2, 1, "visual_description", ["d1"], 18_000, 19_000, "c")],
        "video_id string, list_no int, rank int, modality string, source_ids array<string>, start_ms long, end_ms long, text string",
    )
    chunks = spark.createDataFrame([("v", 0, "c1", 0, 5_000), ("v", 1, "c2", 5_000, 10_000)], SPANS)
    shots = spark.createDataFrame([("v", 0, "h0", 0, 8_000), ("v", 1, "h1", 8_000, 30_000)], SHOTS)
    got = fusion.candidate_windows(hits, chunks, shots, fusion.FusionParams(max_gap_ms=100)).orderBy("rank").collect()
    assert len(got) == 2
    assert (got[0].start_ms, got[0].end_ms, got[0].modalities, got[0].chunk_ids) == (0, 5_000, ["ocr", "transcript"], ["c1"])
    assert (got[1].start_ms, got[1].end_ms, got[1].shot_ids) == (18_000, 19_000, ["h1"])


@pytest.mark.parametrize("cut", [False, True])
def test_clusters_against_brute_force(spark, cut_policy, cut):
    rng = random.Random(5)
    items, spans = [], []
    for n in range(150):
        video = "a" if n % 5 else "b"
        start = rng.randrange(0, 60_000)
        items.append((video, "ocr", f"i{n}", start, start + rng.choice([10, 400, 3_000]), 1.0 / (n + 1), 0, n))
    for n in range(40):
        start = rng.randrange(0, 60_000)
        spans.append(("a" if n % 2 else "b", n, f"c{n}", start, start + rng.choice([500, 4_000])))
    evidence = spark.createDataFrame(items, "video_id string, modality string, source_id string, start_ms long, end_ms long, score double, first_list int, first_rank int")
    params = fusion.FusionParams(max_gap_ms=150, max_window_ms=5_000)
    labelled = fusion.cluster_evidence(evidence, spark.createDataFrame(spans, SPANS), params, cut_policy if cut else None).collect()
    got = {}
    for r in labelled:
        got.setdefault((r.video_id, r.cluster_no), set()).add(r.source_id)
    expected = []
    for video in ("a", "b"):
        clusters = []
        for item in sorted((i for i in items if i[0] == video), key=lambda i: (i[3], i[4], -i[5])):
            if clusters:
                low, high = min(c[3] for c in clusters[-1]), max(c[4] for c in clusters[-1])
                shared = any(s[0] == video and s[3] < high and low < s[4] and s[3] < item[4] and item[3] < s[4] for s in spans)
                if (item[3] <= high + 150 or shared) and max(high, item[4]) - min(low, item[3]) <= 5_000:
                    clusters[-1].append(item)
                    continue
            clusters.append([item])
        expected += [frozenset(i[2] for i in c) for c in clusters]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected))


def test_clusters_out_of_phase_are_handed_over(spark, cut_policy):
    """Evenly spaced items never fall into step, so every shard needs its predecessor's state."""
    items = [("a", "ocr", f"i{n}", n * 10, n * 10 + 10, 1.0, 0, n) for n in range(70)]
    evidence = spark.createDataFrame(items, "video_id string, modality string, source_id string, start_ms long, end_ms long, score double, first_list int, first_rank int")
    none = spark.createDataFrame([], SPANS)
    got = fusion.cluster_evidence(evidence, none, fusion.FusionParams(max_gap_ms=0, max_window_ms=110), cut_policy).collect()
    assert {r.source_id: r.cluster_no for r in got} == {f"i{n}": n // 11 for n in range(70)}


def test_frame_timestamps(spark):
    def spans(*pairs):
        return spark.createDataFrame([("v", s, e) for s, e in pairs], "video_id string, start_ms long, end_ms long")

    def stamps(df):
        return sorted(r.timestamp_ms for r in df.collect())

    assert stamps(frames.uniform_timestamps(spans((0, 1_000), (2_000, 3_000)), 4)) == [250, 750, 2_250, 2_750]
    assert stamps(frames.fixed_rate_timestamps(spans((0, 2_000)), 2)) == [0, 500, 1_000, 1_500]
    assert stamps(frames.fixed_rate_timestamps(spans((0, 2_000), (5_000, 6_000)), 2, 5)) == [0, 500, 1_000, 1_500, 5_000]
    shots = spark.createDataFrame([("v", 0, "h0", 0, 8_000), ("v", 1, "h1", 8_000, 18_000), ("v", 2, "h2", 18_000, 30_000)], SHOTS)
    assert stamps(frames.keyframe_timestamps(spans((0, 30_000)), shots, 2)) == [4_000, 13_000]
    assert frames.sampling_plan("coarse", 1).max_frames == 4
    assert frames.sampling_plan("detailed", 10) == frames.SamplingPlan("dense_window", 1.0, 48)


@pytest.mark.parametrize("count", [1, 2, 4, 50])
def test_even_selection(spark, count):
    items = spark.createDataFrame([("v", n, n + 1) for n in range(11)], "video_id string, start_ms long, end_ms long")
    got = sorted(r.start_ms for r in frames.even_selection(items, count).collect())
    if count >= 11:
        assert got == list(range(11))
    elif count == 1:
        assert got == [5]
    else:
        assert got == sorted({round(i * 10 / (count - 1)) for i in range(count)})


def test_distinct_frames_compare_with_the_last_kept(spark):
    rows = [("v", f"f{n}", n, [float(value)] * 4) for n, value in enumerate([0, 1, 1.9, 2.0, 3.5, 4.0])]
    df = spark.createDataFrame(rows, "video_id string, frame_id string, timestamp_ms long, signature array<double>")
    assert sorted(r.frame_id for r in frames.distinct_frames(df, 2.0).collect()) == ["f0", "f3", "f5"]


def test_budgeted_context_skips_what_does_not_fit(spark):
    rows = [("v", n, f"c{n}", n * 10_000, n * 10_000 + length, n * 10_000, n * 10_000 + length) for n, length in enumerate([3_000, 9_000, 2_000, 5_000, 4_000])]
    chunks = spark.createDataFrame(rows, "video_id string, ord long, chunk_id string, start_ms long, end_ms long, insp_start_ms long, insp_end_ms long")
    anchors = chunks.where("ord = 2")
    got = {r.ord: r.admitted for r in context.budgeted_context(chunks, anchors, context.Direction.BOTH, 2, 10_500).collect()}
    assert got == {2: True, 1: False, 3: True, 0: True, 4: False}
    after = {r.ord for r in context.budgeted_context(chunks, anchors, context.Direction.AFTER, 1, 99_000).collect()}
    assert after == {2, 3}


def reference_tracks(rows, p):
    tracks = []
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        best, score = None, None
        for track in tracks:
            last = track[-1]
            if not 0 <= row[2] - last[2] <= p.max_merge_gap_ms:
                continue
            pair = (text_ratio(row[3], last[3]), _iou(row[4], last[4]))
            if pair[0] >= p.min_text_similarity and pair[1] >= p.min_bbox_iou and (score is None or pair > score):
                best, score = track, pair
        if best is None:
            tracks.append([row])
        else:
            best.append(row)
    return tracks


def _iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(0.0, w) * max(0.0, h)
    return shared / (a[2] * a[3] + b[2] * b[3] - shared) if shared else 0.0


@pytest.mark.parametrize("cut", [False, True])
def test_text_tracks_against_brute_force(spark, cut_policy, cut):
    rng = random.Random(3)
    words = ["Breaking news today", "Breaking news todav", "BREAKING NEWS TODAY", "Weather at six", "Weather at sixx", "Score 3:1"]
    rows, at = [], 0
    for n in range(140):
        at += rng.choice([0, 0, 500, 1_500, 1_501])
        box = (rng.choice([0.0, 0.05, 0.5]), rng.choice([0.0, 0.4]), 0.4, 0.3)
        rows.append(("v", f"o{n:04d}", at, rng.choice(words), box, rng.choice([0.5, 0.7, 0.9])))
    df = spark.createDataFrame(
        rows,
        "video_id string, observation_id string, timestamp_ms long, normalized_text string, "
        "bbox struct<x:double,y:double,width:double,height:double>, confidence double",
    )
    params = screen_text.OcrParams(min_span_occurrences=2)
    tracked = screen_text.assign_tracks(df, params, cut_policy if cut else None)
    got = {tuple(r.observation_ids): (r.start_ms, r.end_ms, r.text) for r in screen_text.text_spans(tracked, params).collect()}
    expected = {}
    for track in reference_tracks(rows, params):
        if len(track) >= 2:
            top = max(track, key=lambda r: r[5])
            expected[tuple(r[1] for r in track)] = (track[0][2], track[-1][2] + 1, top[3])
    assert got == expected


def test_budgeted_context_survives_a_join_turned_into_a_broadcast(spark):
    """Sizes known at run time only: the join before the fold leaves rows where they are."""
    rows = [(v, o, f"c{v}_{o}", o * 10, o * 10 + 4 + (v + o) % 5) for v in range(200) for o in range(12)]
    columns = "video_id long, ord long, chunk_id string, start_ms long, end_ms long"
    wanted = {}
    for v in range(200):
        length = {o: e - s for w, o, _, s, e in rows if w == v}
        used = length[6]
        for o in sorted(set(length) - {6}, key=lambda o: (abs(o - 6), o)):
            if abs(o - 6) <= 4:
                wanted[v, o] = used + length[o] <= 30
                used += length[o] if wanted[v, o] else 0
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        chunks = spark.createDataFrame(rows, columns).repartition(4).withColumns({"insp_start_ms": F.col("start_ms"), "insp_end_ms": F.col("end_ms")})
        placed = context.budgeted_context(chunks, chunks.where("ord = 6").select("video_id", "ord"), context.Direction.BOTH, 4, 30)
        got = {(r.video_id, r.ord): r.admitted for r in placed.where("distance > 0").collect()}
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert got == wanted
