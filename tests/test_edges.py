"""Probe mapping, subtitles, speech, storage, streaming and the tool suite."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.completions import parse_completion, response_problems
from tidemark.functions.timecodes import decimal_seconds_to_ms, format_timestamp, parse_rational, seconds_to_ms
from tidemark.operators import chunking, indexing, media
from tidemark.sources import index_store, manifests, media_tools, trace, video_files
from tidemark.sources.ffprobe import map_probes
from tidemark.sources.webvtt import parse_vtt, read_vtt
from tidemark.streaming.chunks import chunk_labels
from tidemark.streaming.ledger import first_sightings, session_ledger
from tidemark.streaming.trace import start_trace
from tidemark.tools.suite import Dependencies, ToolSuite
from tidemark.tools.workspace import Session, Workspace
from tidemark.udfs import backends

PAYLOAD = {
    "format": {"format_name": "mov,mp4", "duration": "12.3455", "size": "1000", "tags": {"b": "2", "a": "1"}},
    "streams": [
        {"index": 3, "codec_type": "video", "codec_name": "mjpeg", "width": 10, "height": 10, "disposition": {"attached_pic": 1}},
        {"index": 0, "codec_type": "video", "codec_name": "h264", "width": 1920, "height": "1080", "r_frame_rate": "30000/1001",
         "avg_frame_rate": "25/1", "disposition": {"default": 1}, "side_data_list": [{"x": "y"}, {"rotation": -90}], "duration": "N/A"},
        {"index": 1, "codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2, "tags": {"language": "eng"}},
        {"index": 2, "codec_type": "subtitle", "codec_name": "mov_text", "tags": {"title": "T"}},
    ],
}


def probes(spark, *payloads):
    rows = [(f"v{n}", p if isinstance(p, str) else json.dumps(p)) for n, p in enumerate(payloads)]
    return media.with_flags(media.with_primaries(map_probes(spark.createDataFrame(rows, "video_id string, payload string"))))


def test_probe_mapping(spark):
    row = probes(spark, PAYLOAD).first()
    assert row.container.duration_ms == 12_346 and row.container.tags[0].key == "a"
    assert row.primary_video.stream_index == 0 and row.primary_video.rotation_degrees == 270
    assert row.primary_video.frame_rate.numerator == 30_000 and row.primary_video.duration_ms is None
    assert (row.primary_audio.language, row.primary_audio.sample_rate_hz) == ("eng", 48_000)
    assert row.is_variable_frame_rate and row.has_rotation_metadata and row.has_multiple_video_streams and row.mapping_error is None


def test_probe_errors(spark):
    missing = {"streams": [{"index": 0, "codec_type": "video", "height": 4}]}
    twice = {"streams": [{"index": 0, "codec_type": "audio"}, {"index": 0, "codec_type": "audio"}]}
    got = {r.video_id: r.mapping_error for r in probes(spark, "nope", missing, twice, {}).collect()}
    assert "width" in got["v1"] and "unique" in got["v2"] and got["v3"] is None
    assert got["v0"]


@pytest.mark.parametrize(
    "change, policy, status, codes",
    [
        ({}, {}, "valid_with_warnings", ["VARIABLE_FRAME_RATE", "ROTATION_METADATA_PRESENT"]),
        ({}, {"max_width": 1280}, "requires_normalization", ["VARIABLE_FRAME_RATE", "ROTATION_METADATA_PRESENT", "VIDEO_WIDTH_EXCEEDED"]),
        ({}, {"supported_video_codecs": ("vp9",)}, "invalid", ["UNSUPPORTED_VIDEO_CODEC", "VARIABLE_FRAME_RATE", "ROTATION_METADATA_PRESENT"]),
        ({"streams": PAYLOAD["streams"][:1]}, {}, "invalid", ["NO_VIDEO_STREAM"]),
        ({"streams": PAYLOAD["streams"][1:2], "format": {}}, {}, "invalid",
         ["VARIABLE_FRAME_RATE", "ROTATION_METADATA_PRESENT", "MISSING_DURATION", "NO_AUDIO_STREAM", "UNKNOWN_CONTAINER_FORMAT"]),
    ],
)
def test_media_rules(spark, change, policy, status, codes):
    row = media.with_issues(probes(spark, {**PAYLOAD, **change}), media.MediaPolicy(**policy)).first()
    assert [i.code for i in row.issues] == codes
    assert row.validation_status == status and row.next_action == media.NEXT_ACTIONS[status]


def test_rounding_and_timecodes(spark):
    df = spark.createDataFrame([("0.0005", 0.0005), ("0.0015", 0.0015), ("x", 2.5)], "t string, d double")
    got = df.select(decimal_seconds_to_ms(F.col("t")).alias("up"), seconds_to_ms(F.col("d")).alias("even")).collect()
    assert [(r.up, r.even) for r in got] == [(1, 0), (2, 2), (None, 2_500)]
    stamps = spark.range(1).select(format_timestamp(F.lit(3_723_004)).alias("x"), parse_rational(F.lit("0/0")).alias("r")).first()
    assert (stamps.x, stamps.r) == ("01:02:03.004", None)


VTT = "﻿WEBVTT\r\n\r\nintro\r\n00:00:03.000 --> 00:00:04.000\r\nlater\r\n\r\n00:01.000 --> 00:02.500 align:start\n<b>Hello</b> &amp;\nworld\n\n" \
      "00:00:05.000 --> 00:00:05.000\nempty range\n\n00:00:06.000 --> 00:00:07.000\n<i></i>&nbsp;\n\nNOTE no cue"


def test_webvtt(spark, tmp_path):
    (tmp_path / "clip.vtt").write_bytes(VTT.encode())
    got = parse_vtt(read_vtt(spark, str(tmp_path)), "en", 2).orderBy("ord").collect()
    assert [(r.start_ms, r.end_ms, r.normalized_text, r.segment_id) for r in got] == [
        (1_000, 2_500, "Hello & world", "subtitle_clip_000001"), (3_000, 4_000, "later", "subtitle_clip_000000")]


def test_speech_is_clamped_to_the_source(spark):
    words = "array<struct<text:string,start_seconds:double,end_seconds:double,probability:double>>"
    rows = [("v", 0, " a  b ", 0.5, 2.0, [(" a ", 0.4, 1.0, 0.5), ("b", 1.0, 3.0, 1.0)]), ("v", 1, "c", 4.5, 6.0, []), ("v", 2, "gone", 5.0, 6.0, [])]
    found = spark.createDataFrame(rows, f"video_id string, ord long, text string, start_seconds double, end_seconds double, words {words}")
    audio = spark.createDataFrame([("v", 10_000, 15_000)], "video_id string, source_start_ms long, source_end_ms long")
    got = media.speech_segments(found, audio).orderBy("ord").collect()
    assert [(r.start_ms, r.end_ms, r.normalized_text, r.confidence) for r in got] == [(10_500, 12_000, "a b", 0.75), (14_500, 15_000, "c", None)]
    assert [(w.text, w.start_ms, w.end_ms) for w in got[0].words] == [("a", 10_500, 11_000), ("b", 11_000, 12_000)]


def test_completions(spark):
    rows = [('```json\n{"description": " d ", "tags": ["a", " a", ""], "confidence": 2}\n```',), ('{"description": ""}',), ('{"description": "e", "confidence": 0.5}',)]
    got = [r.c for r in spark.createDataFrame(rows, "t string").select(parse_completion(F.col("t")).alias("c")).collect()]
    assert (got[0].description, got[0].tags, got[0].confidence) == ("d", ["a"], None)
    assert got[1] is None and (got[2].tags, got[2].confidence) == ([], 0.5)
    targets = spark.createDataFrame([("r", "t", ["f"])], "request_id string, target_id string, frame_ids array<string>")
    answers = spark.createDataFrame([("r", "t", "x", ["g"], [], 0.5), ("r", "u", "x", [], [], 0.5)],
                                    "request_id string, target_id string, text string, frame_ids array<string>, tags array<string>, confidence double")
    assert {r.target_id: r.problem for r in response_problems(answers, targets).collect()} == {"t": "foreign_frames", "u": "unknown_target"}


def test_registration_hashes_files(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"abc")
    before = video_files.register_videos(spark, str(tmp_path), "*.mp4")
    row = before.first()
    assert row.video_id == "video_ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and row.size_bytes == 3
    stored = spark.createDataFrame([row])
    assert video_files.changed_files(stored, before).count() == 0
    (tmp_path / "a.mp4").write_bytes(b"abcd")
    assert video_files.changed_files(stored, video_files.register_videos(spark, str(tmp_path), "*.mp4")).first().problem == "file_changed"
    names = spark.createDataFrame([("ok.mp4",), ("a/b",), ("..",), (" ",)], "n string").select(video_files.filename_problem(F.col("n")).alias("p")).collect()
    assert [r.p is None for r in names] == [True, False, False, False]


def test_manifests_and_indexes_on_disk(spark, tmp_path):
    shots = spark.createDataFrame([("v", 0, "h0", 0, 5, 0.5), ("v", 1, "h1", 3, 9, None), ("v", 2, "h2", 2, 2, None)], manifests.SCHEMAS["shots"])
    manifests.write_json(shots, str(tmp_path / "json"))
    manifests.write_table(manifests.read_json(spark, "shots", str(tmp_path / "json")), str(tmp_path / "table"))
    back = manifests.read_table(spark, "shots", str(tmp_path / "table"))
    assert sorted(back.collect()) == sorted(shots.collect())
    assert {r.ord: r.problem for r in manifests.range_problems(back).collect()} == {2: "empty_range"}
    documents = spark.createDataFrame([("v", "d", "red car", 0, 5, ["d"], ["en"])], manifests.SCHEMAS["index_documents"])
    index_store.write_text_index(indexing.text_index(documents), str(tmp_path / "text"), "transcript")
    assert index_store.read_text_index(spark, str(tmp_path / "text"), "transcript", "v").first().token_counts == {"red": 1, "car": 1}
    vectors = spark.createDataFrame([("d", [3.0, 4.0])], "item_id string, vector array<double>")
    index_store.write_dense_index(indexing.dense_index(documents, vectors, 2), str(tmp_path / "dense"), "transcript", "space", 2)
    assert index_store.read_dense_index(spark, str(tmp_path / "dense"), "transcript", "space", 2).first().vector == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="embedding spaces"):
        index_store.read_dense_index(spark, str(tmp_path / "dense"), "transcript", "other", 2).collect()


def test_trace_round_trip(spark, tmp_path):
    rows = [("r", 2, "2024-01-01 00:00:01.500", "b", {"api_key": "s"}), ("r", 1, "2024-01-01 00:00:00", "a", {"x": "1"})]
    events = spark.createDataFrame(rows, "run_id string, event_id long, at string, type string, payload map<string,string>").withColumn("recorded_at", F.to_timestamp("at"))
    trace.write_trace(trace.trace_events(events), str(tmp_path / "t"))
    got = trace.read_trace(spark, str(tmp_path / "t")).orderBy("sequence").collect()
    assert [(r.sequence, r.elapsed_ms, r.type, r.payload) for r in got] == [(1, 0, "a", {"x": "1"}), (2, 1_500, "b", {"api_key": "[REDACTED]"})]


def test_redaction_reaches_every_depth(spark):
    kind = "struct<headers:map<string,string>,calls:array<struct<name:string,api_key:string,auth:struct<refresh_token:string,n:int>>>,password:int,note:string>"
    payload = ({"Authorization": "Bearer x", "accept": "y"}, [("a", "k", ("t", 3)), None], 7, "kept")
    events = spark.createDataFrame([("r", 1, "2024-01-01 00:00:00", "t", payload), ("r", 2, "2024-01-01 00:00:01", "t", None)], f"run_id string, event_id long, at string, type string, payload {kind}")
    rows = trace.trace_events(events.withColumn("recorded_at", F.to_timestamp("at"))).orderBy("sequence").collect()
    found = rows[0].payload
    assert found.headers == {"Authorization": "[REDACTED]", "accept": "y"} and found.note == "kept" and found.password is None
    assert (found.calls[0].name, found.calls[0].api_key, found.calls[0].auth.refresh_token, found.calls[0].auth.n) == ("a", "[REDACTED]", "[REDACTED]", 3)
    assert found.calls[1] is None and rows[1].payload is None


def test_missing_programs_are_reported(spark):
    files = spark.createDataFrame([("v", "/none.mp4")], "video_id string, uri string")
    row = media_tools.probe_files(files, "no-such-program").first()
    assert row.payload is None and "not installed" in row.error


# ---- streaming ---------------------------------------------------------------

def run_stream(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def as_stream(spark, rows, schema, folder, parts):
    """One file, hence one micro-batch, per part."""
    import time

    for part in range(parts):
        chunk = rows[part * len(rows) // parts : (part + 1) * len(rows) // parts]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streaming_ledger(spark, tmp_path):
    schema = "run_id string, call_no long, candidate_ids array<string>, start_ms long, end_ms long, tokens long"
    rows = [("r", 1, ["a", "b"], 0, 10, 40), ("r", 2, ["a"], 5, 20, 20), ("r", 3, ["b"], None, None, 30), ("r", 4, [], 6, 12, 0)]
    out = run_stream(spark, session_ledger(as_stream(spark, rows, schema, str(tmp_path / "c"), 2), 100), "ledger_rows").orderBy("call_no").collect()
    assert [(r.new_candidates, r.reused_candidates, r.newly_covered_ms, r.covered_ms, r.streak, r.spent) for r in out] == [
        (2, 0, 10, 10, 0, 40), (0, 1, 10, 20, 0, 60), (0, 1, 0, 20, 1, 90), (0, 0, 0, 20, 2, 90)]
    assert [list(r.warnings) for r in out] == [[], [0.5], [0.75, 0.9], []] and out[3].replan


def test_streaming_chunks_match_batch(spark, tmp_path):
    from tests.test_segments import SEGMENTS, make_segments

    rows = make_segments(21, 90)
    schema = SEGMENTS
    out = run_stream(spark, chunk_labels(as_stream(spark, rows, schema, str(tmp_path / "s"), 3)), "chunk_rows").collect()
    batch = chunking.assign_chunks(spark.createDataFrame(rows, schema)).collect()
    assert {r.ord: r.chunk_no for r in out} == {r.ord: r.chunk_no for r in batch}


def test_streaming_dedup_and_trace(spark, tmp_path):
    rows = [("r", "a"), ("r", "a"), ("r", "b"), ("s", "a")]
    hits = as_stream(spark, rows, "run_id string, candidate_id string", str(tmp_path / "h"), 2)
    assert run_stream(spark, first_sightings(hits), "sightings").count() == 3
    events = as_stream(spark, [("r", "t", {"secret": "x", "y": "z"})], "run_id string, type string, payload map<string,string>", str(tmp_path / "e"), 1)
    start_trace(events, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).first().payload.secret == "[REDACTED]"


# ---- tools ---------------------------------------------------------------------

class FakeModel:
    def describe(self, frame_uris, question):
        return {"description": f"{len(frame_uris)} frames", "tags": ["t"], "confidence": 0.9}


class FakeReader:
    def recognize(self, uri):
        return {"width": 100, "height": 100, "detections": [{"text": "SALE 50%", "polygon": [[0, 0], [50, 0], [50, 20], [0, 20]], "confidence": 0.9}]}


@pytest.fixture(scope="module")
def suite(spark):
    segments = spark.createDataFrame(
        [("v", n, f"s{n}", n * 5_000, n * 5_000 + 4_000, text, text, "asr", "en", None) for n, text in enumerate(
            ["The red car stops.", "Nobody moves.", "A door opens slowly.", "They leave the house."])],
        "video_id string, ord long, segment_id string, start_ms long, end_ms long, raw_text string, normalized_text string, source string, language string, confidence double",
    )
    shots = spark.createDataFrame([("v", 0, "h0", 0, 10_000), ("v", 1, "h1", 10_000, 20_000)], "video_id string, ord long, shot_id string, start_ms long, end_ms long")
    params = chunking.ChunkParams(target_characters=10, max_characters=60)
    chunks = chunking.with_inspection(chunking.build_chunks(segments, params), shots, params)
    chunks = chunks.withColumns({"insp_start_ms": F.coalesce("insp_start_ms", "start_ms"), "insp_end_ms": F.coalesce("insp_end_ms", "end_ms")}).persist()
    index = indexing.text_index(indexing.transcript_documents(segments, chunks)).persist()

    def sample(stamps):
        return stamps.select("video_id", F.concat(F.lit("f"), "timestamp_ms").alias("frame_id"), "timestamp_ms", F.lit("/f.jpg").alias("image_uri"))

    def export(requests):
        return requests.select("start_ms", "end_ms", F.lit("/clip.mp4").alias("output_uri"))

    workspace = Workspace(chunks=chunks, shots=shots, segments=segments, text_index=index, probes=probes(spark, PAYLOAD).withColumn("video_id", F.lit("v")))
    return ToolSuite(spark, workspace, Dependencies(sample, FakeModel, FakeReader, None, export))


def test_search_reports_novelty_then_reuse(suite):
    session = Session("v")
    first = suite.invoke("search_video_transcript", session, query="door opens")
    assert first.status == "success" and len(first.output["new_candidates"]) == 1 and not first.no_information_gain
    again = [suite.invoke("search_video_transcript", session, query="door opens") for _ in range(2)]
    assert all(r.no_information_gain and len(r.output["reused_candidates"]) == 1 for r in again) and session.requires_replan
    found = first.output["new_candidates"][0]
    around = suite.invoke("resolve_timeline_context", session, candidate_ids=(found["candidate_id"],), adjacent_chunks=1)
    assert len(around.output["chunk_ids"]) == 3 and around.new_evidence_ids
    assert suite.invoke("resolve_timeline_context", session, chunk_ids=("nope",)).status == "failed"


def test_scan_covers_the_video(suite):
    session = Session("v")
    assert suite.invoke("scan_video_timeline", session, question="what?").status == "failed"
    suite.invoke("get_video_metadata", session)
    session.duration_ms = 20_000
    got = suite.invoke("scan_video_timeline", session, question="what?")
    assert got.output["coverage_ratio"] == 1.0 and got.output["exhausted"] and len(got.output["candidates"]) == 2
    assert suite.invoke("scan_video_timeline", session, question="what?").output["candidates"] == []


def test_looking_reading_and_exporting(suite):
    session = Session("v", duration_ms=20_000)
    seen = suite.invoke("inspect_visual_content", session, question="who?", spans=((0, 10_000),))
    assert seen.output["observations"][0]["text"] == "1 frames" and seen.output["newly_covered"] == [(0, 10_000)]
    text = suite.invoke("read_screen_text", session, spans=((0, 3_000),))
    assert [s["text"] for s in text.output["spans"]] == ["SALE 50%"] and text.output["spans"][0]["span"] == (0, 2_001)
    evidence = seen.new_evidence_ids
    assert "NOT_AUTHORIZED" in suite.invoke("export_evidence_clip", session, evidence_ids=evidence).error
    session.clip_requested, session.verified_evidence_ids = True, frozenset(evidence)
    assert "LIMIT" in suite.invoke("export_evidence_clip", session, evidence_ids=evidence, padding_before_ms=6_000).error
    clip = suite.invoke("export_evidence_clip", session, evidence_ids=evidence, padding_before_ms=0, padding_after_ms=0)
    assert clip.output["ranges"] == [(0, 10_000)] and not clip.output["cache_hit"]
    assert suite.invoke("export_evidence_clip", session, evidence_ids=evidence, padding_before_ms=0, padding_after_ms=0).output["cache_hit"]


def test_budget_and_registry(suite):
    session = Session("v", max_tool_calls=1)
    assert suite.invoke("nothing", session).status == "failed"
    suite.invoke("get_video_metadata", session)
    assert "budget" in suite.invoke("get_video_metadata", session).error
    assert len(suite.specifications()) == 7 and all(s["available"] for s in suite.specifications())


def test_back_end_failures_become_rows(spark):
    class Broken:
        def transcribe(self, uri, language):
            raise RuntimeError("no model")

    audio = spark.createDataFrame([("v", "/a.wav", None)], "video_id string, uri string, language string")
    assert backends.transcribe(audio, Broken, retries=0).first().error == "no model"
    assert backends.spread(list(range(9)), 4) == [0, 3, 5, 8]
