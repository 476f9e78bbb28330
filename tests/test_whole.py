"""Whole runs: incremental preprocessing, the question loop, environment checks, the registry."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.test_edges import PAYLOAD
from tidemark.functions.text import text_ratio
from tidemark.operators.chunking import ChunkParams
from tidemark.operators.preprocessing import PreprocessingParams, StageStore, preprocess
from tidemark.tools import doctor
from tidemark.tools.agent import Decision, Draft, Limits, QuestionLoop
from tidemark.tools.suite import ToolSuite
from tidemark.tools.workspace import Session, Workspace
from tidemark.udfs.backends import HashingEmbedder

VTT = "WEBVTT\n\n00:01.000 --> 00:04.000\nA red car stops here.\n\n00:04.200 --> 00:07.000\nThe door opens slowly.\n"


@pytest.fixture(scope="module")
def inputs(spark):
    good = json.dumps(PAYLOAD)
    videos = spark.createDataFrame(
        [("sub", "h1", good, VTT), ("asr", "h2", good, None), ("mute", "h3", good, None), ("bad", "h4", json.dumps({"streams": []}), None)],
        "video_id string, content_hash string, payload string, subtitles string",
    )
    cuts = spark.createDataFrame(
        [(v, 0, 0.0, 6.0) for v in ("sub", "asr", "mute")] + [(v, 1, 6.0, 60.0) for v in ("sub", "asr", "mute")],
        "video_id string, ord long, start_seconds double, end_seconds double",
    )
    words = "array<struct<text:string,start_seconds:double,end_seconds:double,probability:double>>"
    heard = spark.createDataFrame([("asr", 0, "Somebody speaks.", 0.5, 2.0, [])], f"video_id string, ord long, text string, start_seconds double, end_seconds double, words {words}")
    return videos, cuts, heard


def test_preprocessing_is_incremental(spark, inputs, tmp_path):
    videos, cuts, heard = inputs
    params = PreprocessingParams(ChunkParams(target_characters=10, max_characters=100), dense_policy="optional", dimensions=16)

    def run(table):
        store = StageStore(spark, str(tmp_path))
        return store, preprocess(store, table, cuts, heard, params, lambda: HashingEmbedder(16))

    store, first = run(videos)
    assert {r.video_id for r in first.rejected.collect()} == {"bad"}
    status = {r.video_id: (r.status, r.transcript_ready) for r in first.readiness.collect()}
    assert status == {"sub": ("ready", True), "asr": ("ready", True), "mute": ("partial", False)}
    assert {(r.video_id, r.basis) for r in first.chunks.select("video_id", "basis").distinct().collect()} == {
        ("sub", "transcript"), ("asr", "transcript"), ("mute", "shot_fallback")}
    assert first.chunks.where("video_id = 'sub'").count() == 2 and first.dense_index.count() == 3
    assert set(store.reused.values()) == {0}
    before = sorted(first.chunks.collect())

    store, second = run(videos)
    assert set(store.built.values()) == {0} and sorted(second.chunks.collect()) == before

    # what a build wrote that did not come to its end is not read
    path = str(tmp_path / "chunks")
    torn = spark.read.parquet(path).withColumn("build_id", F.lit("torn"))
    torn.write.mode("append").partitionBy("derivation_key").parquet(path)
    store, again = run(videos)
    assert set(store.built.values()) == {0} and sorted(again.chunks.collect()) == before
    louder = heard.withColumn("text", F.lit("Somebody shouts."))
    store = StageStore(spark, str(tmp_path))
    spoken = preprocess(store, videos, cuts, louder, params, lambda: HashingEmbedder(16))
    assert store.built["segments"] == 1 and store.built["shots"] == 0 and spoken.segments.where("video_id = 'asr'").first().raw_text == "Somebody shouts."

    changed = videos.withColumn("subtitles", F.when(F.col("video_id") == "sub", VTT + "\n00:08.000 --> 00:09.000\nThe end.\n").otherwise(F.col("subtitles")))
    store, third = run(changed)
    assert store.built == {name: 1 for name in store.built} and third.chunks.where("video_id = 'sub'").count() == 3


def test_question_loop(spark, inputs, tmp_path):
    videos, cuts, heard = inputs
    done = preprocess(StageStore(spark, str(tmp_path)), videos, cuts, heard, PreprocessingParams(ChunkParams(target_characters=10, max_characters=100)))
    suite = ToolSuite(spark, Workspace(done.chunks, done.shots, done.segments, done.text_index, probes=done.probes))

    def planner(question, session, events, feedback):
        if not events:
            return Decision("local_event", "search_video_transcript", {"query": question})
        if len(events) == 1 and not feedback:
            return Decision("local_event", evidence_ids=("ghost",))
        return Decision("local_event", evidence_ids=tuple(session.evidence))

    def writer(question, evidence):
        return Draft("The door opens.", [("The door opens.", tuple(e["evidence_id"] for e in evidence), 0.9)])

    answer = QuestionLoop(spark, suite, planner, writer).ask("door opens", Session("sub"))
    assert answer.status == "completed" and answer.citations[0]["excerpt"] == "The door opens slowly."

    stubborn = QuestionLoop(spark, suite, lambda *_: Decision("visual", evidence_ids=("ghost",)), writer, Limits(max_remediations=1))
    refused = stubborn.ask("who?", Session("sub"))
    assert refused.status == "abstained" and "Visual evidence is required" in refused.reason
    repeating = QuestionLoop(spark, suite, lambda *_: Decision("local_event", "search_video_transcript", {"query": "x"}), writer, Limits(max_replans=0))
    assert "made before" in repeating.ask("x", Session("sub")).reason


def test_doctor(spark, tmp_path):
    checks = doctor.run_checks(spark, str(tmp_path), str(tmp_path / "out"))
    assert {c.name: c.status for c in checks}["checkpoints"] == "ok"
    assert doctor.report(spark, checks).count() == len(checks)
    assert doctor.is_ok(checks) == all(c.status != "error" for c in checks)


SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "range_gaps", "overlap_semi_join", "greedy_chunks_lines", "inspection_range", "bm25_per_video", "hybrid_rrf",
    "candidate_fusion", "claim_verification", "catalog_audit", "vtt_parse", "new_vs_reused",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_registered_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "documents", "conversations", "embeddings", "labels", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    found = contract.queries()[name](spark, SMALL)
    expected = con.sql(contract.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    got = sorted(map(repr, (tuple(row) for row in found.select(*columns).collect())))
    picked = ", ".join(f'"{c}"' for c in columns)
    want = sorted(map(repr, con.sql(f"SELECT {picked} FROM ({contract.oracle_sql()[name]})").fetchall()))
    assert got == want


def test_queries_without_sql_against_python(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for row in contract.queries()["page_plain_text"](spark, SMALL).collect():
        assert row.text == " ".join(html.unescape(re.sub("<[^>]+>", "", pages[row.page_id])).split())
    spans = contract.queries()["ocr_track_merge"](spark, SMALL)
    lines = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("l")).where("trim(l) <> ''").count()
    assert spans.agg(F.sum("occurrences")).first()[0] == lines
    assert text_ratio("a", "A") == 1.0


def test_entry_runs(spark):
    assert contract.entry(spark).columns == ["item_id", "rank", "score"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
