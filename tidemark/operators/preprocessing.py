"""From probe output, subtitles and speech to searchable tables, for many videos at once.

Every stage is incremental: videos whose inputs and parameters did not change
keep their stored rows; only the others are computed and appended.  A stage's
identity is its derivation key (producer, version, parameters) plus the input
hash of the video, which chains through the stages, so nothing is re-read to
find out that it is current.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import derivation_key
from tidemark.operators import catalog, chunking, indexing, media
from tidemark.session import cut_lineage
from tidemark.sources.ffprobe import map_probes
from tidemark.sources.webvtt import parse_vtt
from tidemark.udfs import backends

RUNS_SCHEMA = "video_id string, stage string, derivation_key string, input_hash string, build_id string"


class StageStore:
    """Stage outputs below one root: ``<root>/<stage>`` and the run list ``<root>/runs``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.reused: dict[str, int] = {}
        self.built: dict[str, int] = {}
        self.runs_path = os.path.join(root, "runs")
        spark.createDataFrame([], RUNS_SCHEMA).write.mode("ignore").parquet(self.runs_path)

    def stage(
        self, name: str, key: str, inputs: DataFrame, build: Callable[[DataFrame], DataFrame]
    ) -> DataFrame:
        """Rows of ``name`` for the videos in ``inputs`` (``video_id, input_hash``).

        ``build`` gets the videos without a current result.  Every build writes under
        an id of its own, which the run list, appended last, makes count; what a build
        that failed before that has written is never read.
        """
        done = self.spark.read.schema(RUNS_SCHEMA).parquet(self.runs_path).where(
            (F.col("stage") == name) & (F.col("derivation_key") == key)
        )
        on = ["video_id", "input_hash"]
        missing = cut_lineage(inputs.select(*on).join(done.select(*on), on, "left_anti"))
        self.built[name] = missing.count()
        self.reused[name] = inputs.count() - self.built[name]
        path = os.path.join(self.root, name)
        if self.built[name]:
            build_id = uuid.uuid4().hex
            rows = build(missing).join(missing, "video_id").withColumns({"derivation_key": F.lit(key), "build_id": F.lit(build_id)})
            rows.write.mode("append").partitionBy("derivation_key").parquet(path)
            missing.select(
                "video_id", F.lit(name).alias("stage"), F.lit(key).alias("derivation_key"), "input_hash", F.lit(build_id).alias("build_id")
            ).write.mode("append").parquet(self.runs_path)
        runs = self.spark.read.schema(RUNS_SCHEMA).parquet(self.runs_path).where(
            (F.col("stage") == name) & (F.col("derivation_key") == key)
        )
        # two runs at the same time may both have built a video: one of them is taken
        counted = runs.groupBy(*on).agg(F.min("build_id").alias("build_id")).join(inputs.select(*on), on, "left_semi")
        stored = self.spark.read.parquet(path).where(F.col("derivation_key") == key)
        return stored.join(counted, [*on, "build_id"], "left_semi").drop("input_hash", "derivation_key", "build_id")


def next_hash(inputs: DataFrame, key: str, *more: Column) -> DataFrame:
    """The input hash of a following stage: this stage's key and input, and other inputs."""
    return inputs.select("video_id", F.sha2(F.concat_ws("|", "input_hash", F.lit(key), *more), 256).alias("input_hash"))


def content_hashes(table: DataFrame, name: str) -> DataFrame:
    """``video_id`` and a hash of the video's rows in ``table``, whatever their order."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(table.columns)))).cast("decimal(38,0)")
    return table.groupBy("video_id").agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(row)).alias(name))


@dataclass(frozen=True)
class PreprocessingParams:
    chunking: chunking.ChunkParams = field(default_factory=chunking.ChunkParams)
    media: media.MediaPolicy = field(default_factory=media.MediaPolicy)
    dense_policy: str = "disabled"
    dimensions: int = 0
    language: str | None = None


@dataclass
class Preprocessed:
    probes: DataFrame
    rejected: DataFrame
    shots: DataFrame
    segments: DataFrame
    chunks: DataFrame
    text_index: DataFrame
    dense_index: DataFrame | None
    readiness: DataFrame


def preprocess(
    store: StageStore,
    videos: DataFrame,
    cuts: DataFrame,
    recognised: DataFrame | None = None,
    params: PreprocessingParams = PreprocessingParams(),
    embedder: Callable[[], backends.TextEmbedder] | None = None,
) -> Preprocessed:
    """Run all stages.

    ``videos``: ``video_id, content_hash, payload, subtitles`` (VTT text or
    NULL); ``cuts``: detector output; ``recognised``: recogniser output for
    videos without subtitles.  Unusable videos end up in ``rejected``.
    """
    hashed = videos.select(
        "video_id",
        F.sha2(F.concat_ws("|", "content_hash", "payload", F.coalesce("subtitles", F.lit(""))), 256).alias("input_hash"),
    )

    probe_key = derivation_key("media-inspection", "1", asdict(params.media))

    def inspect(todo: DataFrame) -> DataFrame:
        payloads = videos.join(todo, "video_id", "left_semi").select("video_id", "payload")
        return media.with_issues(media.with_flags(media.with_primaries(map_probes(payloads))), params.media)

    probes = store.stage("probes", probe_key, hashed, inspect)
    sources = media.source_range(probes)
    usable = probes.join(sources, "video_id").where(
        "processable AND mapping_error IS NULL AND source_end_ms IS NOT NULL"
    )
    rejected = probes.join(usable.select("video_id"), "video_id", "left_anti").select(
        "video_id", "validation_status", "next_action", "mapping_error"
    )
    accepted = cut_lineage(usable.select("video_id", "source_start_ms", "source_end_ms"))
    after_probe = next_hash(hashed, probe_key).join(accepted, "video_id", "left_semi")

    def with_output(table: DataFrame | None) -> DataFrame:
        """The input hashes with that of a detector's or recogniser's output for the video."""
        if table is None:
            return after_probe
        own = content_hashes(table, "_content")
        return next_hash(after_probe.join(own, "video_id", "left"), "output", F.coalesce("_content", F.lit("")))

    before_shots, before_text = with_output(cuts), with_output(recognised)

    shot_key = derivation_key("shot-detection", "1", {})

    def find_shots(todo: DataFrame) -> DataFrame:
        found = chunking.detected_shots(cuts, accepted.join(todo, "video_id", "left_semi"))
        return found.withColumn("shot_id", F.concat_ws("_", F.lit("shot"), "video_id", F.format_string("%06d", "ord")))

    shots = store.stage("shots", shot_key, before_shots, find_shots)

    text_key = derivation_key("transcript", "1", {"language": params.language})
    columns = ["video_id", "ord", "segment_id", "start_ms", "end_ms", "raw_text", "normalized_text", "source", "language", "confidence"]

    def transcribe(todo: DataFrame) -> DataFrame:
        wanted = videos.join(todo, "video_id", "left_semi")
        subtitled = wanted.where("subtitles IS NOT NULL").select("video_id", F.col("subtitles").alias("text"))
        segments = parse_vtt(subtitled, params.language).withColumn("confidence", F.lit(None).cast("double")).select(*columns)
        if recognised is not None:
            heard = recognised.join(wanted.where("subtitles IS NULL"), "video_id", "left_semi")
            spoken = media.speech_segments(heard, accepted).withColumn("language", F.lit(params.language).cast("string"))
            segments = segments.unionByName(spoken.select(*columns))
        return segments

    segments = store.stage("segments", text_key, before_text, transcribe)

    chunk_key = derivation_key("temporal-chunking", "1", asdict(params.chunking))
    both = before_shots.join(before_text.select("video_id", F.col("input_hash").alias("_text_hash")), "video_id")
    before_chunks = next_hash(both, chunk_key, F.lit(shot_key), F.lit(text_key), F.col("_text_hash"))

    def cut_chunks(todo: DataFrame) -> DataFrame:
        ranges = accepted.join(todo, "video_id", "left_semi")
        own_shots = shots.join(todo, "video_id", "left_semi")
        spoken = chunking.build_chunks(segments.join(todo, "video_id", "left_semi"), params.chunking, ranges)
        aligned = chunking.with_inspection(spoken, own_shots, params.chunking).select(
            "video_id", "ord", "chunk_id", "start_ms", "end_ms", "shot_ids", "segment_ids", "insp_start_ms", "insp_end_ms", "text", "basis"
        )
        silent = ranges.join(spoken.select("video_id").distinct(), "video_id", "left_anti")
        fallback = chunking.shot_fallback_chunks(own_shots, silent).select(
            "video_id",
            F.col("shot_ord").alias("ord"),
            F.concat_ws("_", F.lit("chunk"), "video_id", F.format_string("%06d", "shot_ord")).alias("chunk_id"),
            "start_ms", "end_ms", "shot_ids",
            F.array().cast("array<string>").alias("segment_ids"),
            "insp_start_ms", "insp_end_ms",
            F.lit(None).cast("string").alias("text"),
            "basis",
        )
        return aligned.unionByName(fallback)

    chunks = store.stage("chunks", chunk_key, before_chunks, cut_chunks)

    index_key = derivation_key("transcript-indexing", "1", {})
    before_index = next_hash(before_chunks, index_key)

    def index_text(todo: DataFrame) -> DataFrame:
        documents = indexing.transcript_documents(
            segments.join(todo, "video_id", "left_semi"), chunks.join(todo, "video_id", "left_semi")
        )
        return indexing.text_index(documents)

    text_index = store.stage("text_index", index_key, before_index, index_text)

    dense_index = None
    if params.dense_policy != "disabled" and embedder is not None:
        dense_key = derivation_key("dense-indexing", "1", {"dimensions": params.dimensions})
        before_dense = next_hash(before_index, dense_key)

        def index_vectors(todo: DataFrame) -> DataFrame:
            documents = text_index.join(todo, "video_id", "left_semi").drop("token_counts", "doc_length")
            return backends.embed_documents(documents, embedder, params.dimensions)

        dense_index = store.stage("dense_index", dense_key, before_dense, index_vectors)

    def present(table: DataFrame | None, name: str) -> DataFrame:
        if table is None:
            return accepted.select("video_id", F.lit(False).alias(name))
        held = table.select("video_id").distinct().withColumn(name, F.lit(True))
        return accepted.select("video_id").join(held, "video_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    ready = present(shots, "shots_ready")
    for table, name in (
        (segments, "transcript_ready"), (chunks, "timeline_ready"), (text_index, "sparse_search_ready"), (dense_index, "dense_search_ready"),
    ):
        ready = ready.join(present(table, name), "video_id")
    limitations = [
        F.when(~F.col("shots_ready"), "Shot detection is unavailable; chunks are not shot-aligned."),
        F.when(~F.col("transcript_ready"), "No transcript is available; subtitle search is disabled."),
        F.when(~F.col("sparse_search_ready"), "Sparse transcript search is unavailable."),
    ]
    if params.dense_policy != "disabled":
        limitations.append(F.when(~F.col("dense_search_ready"), "Dense transcript search is unavailable."))
    ready = catalog.pipeline_status(ready, params.dense_policy).withColumn(
        "limitations", F.array_compact(F.array(*limitations))
    )
    return Preprocessed(probes, rejected, shots, segments, chunks, text_index, dense_index, ready)
