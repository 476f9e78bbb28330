"""Plug-in points for models: embeddings, speech, on-screen text, visual descriptions.

A back end is built once per task from a picklable factory and fed batches.  Its
failures become rows with an ``error``, never a failed job, and are retried when
marked transient.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.vectors import normalize_vector


class TransientBackendError(RuntimeError):
    """Worth another attempt."""


class TextEmbedder(Protocol):
    dimensions: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Transcriber(Protocol):
    def transcribe(self, uri: str, language: str | None) -> list[dict[str, Any]]: ...


class TextReader(Protocol):
    def recognize(self, uri: str) -> dict[str, Any]: ...


class VisualModel(Protocol):
    def describe(self, frame_uris: Sequence[str], question: str | None) -> dict[str, Any]: ...


class HashingEmbedder:
    """Deterministic bag-of-words vectors; for tests and dry runs."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        vectors = np.zeros((len(texts), self.dimensions), dtype="float32")
        for row, text in enumerate(texts):
            for word in text.lower().split():
                vectors[row, zlib.crc32(word.encode()) % self.dimensions] += 1.0
            if not vectors[row].any():
                vectors[row, 0] = 1.0
        return vectors


def with_retries(call: Callable[[], Any], retries: int, pause_seconds: float = 0.5) -> Any:
    for attempt in range(retries + 1):
        try:
            return call()
        except TransientBackendError:
            if attempt == retries:
                raise
            time.sleep(pause_seconds * 2**attempt)


def embed_documents(
    documents: DataFrame,
    factory: Callable[[], TextEmbedder],
    dimensions: int,
    batch_size: int = 256,
) -> DataFrame:
    """Add a unit ``vector`` to rows with ``text``; one model per task, batched calls."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            values = texts.tolist()
            parts = [
                np.asarray(model.embed(values[i : i + batch_size]), dtype="float32")
                for i in range(0, len(values), batch_size)
            ]
            yield pd.Series([row for part in parts for row in part], index=texts.index, dtype="object")

    # explode(array(x)) keeps the model from running once per use of the vector
    embedded = documents.withColumn("_raw", F.explode(F.array(embed(F.col("text")))))
    return embedded.withColumn("vector", normalize_vector(F.col("_raw"), dimensions)).drop("_raw")


TRANSCRIPT_SCHEMA = (
    "video_id STRING, ord BIGINT, text STRING, start_seconds DOUBLE, end_seconds DOUBLE, "
    "words ARRAY<STRUCT<text: STRING, start_seconds: DOUBLE, end_seconds: DOUBLE, probability: DOUBLE>>, error STRING"
)


def transcribe(audio: DataFrame, factory: Callable[[], Transcriber], retries: int = 1) -> DataFrame:
    """Recognised segments of ``video_id, uri, language`` rows; feed to ``speech_segments``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            for item in batch.itertuples(index=False):
                try:
                    found = with_retries(lambda: model.transcribe(item.uri, item.language), retries)
                    rows = [
                        (item.video_id, i, s["text"], float(s["start_seconds"]), float(s["end_seconds"]), s.get("words", []), None)
                        for i, s in enumerate(found)
                    ]
                except Exception as error:
                    rows = [(item.video_id, None, None, None, None, None, str(error))]
                yield pd.DataFrame(rows, columns=["video_id", "ord", "text", "start_seconds", "end_seconds", "words", "error"])

    return audio.select("video_id", "uri", "language").mapInPandas(run, TRANSCRIPT_SCHEMA)


DETECTION_SCHEMA = (
    "video_id STRING, frame_id STRING, detection_no BIGINT, text STRING, polygon ARRAY<ARRAY<DOUBLE>>, "
    "confidence DOUBLE, width INT, height INT, error STRING"
)


def read_frames(frames: DataFrame, factory: Callable[[], TextReader], retries: int = 1) -> DataFrame:
    """Text detections of ``video_id, frame_id, image_uri`` rows; feed to ``observations``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        names = ["video_id", "frame_id", "detection_no", "text", "polygon", "confidence", "width", "height", "error"]
        for batch in batches:
            rows: list[tuple] = []
            for frame in batch.itertuples(index=False):
                try:
                    result = with_retries(lambda: model.recognize(frame.image_uri), retries)
                    rows += [
                        (frame.video_id, frame.frame_id, i, d["text"], d["polygon"], float(d["confidence"]),
                         result["width"], result["height"], None)
                        for i, d in enumerate(result["detections"])
                    ]
                except Exception as error:
                    rows.append((frame.video_id, frame.frame_id, None, None, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=names)

    return frames.select("video_id", "frame_id", "image_uri").mapInPandas(run, DETECTION_SCHEMA)


DESCRIPTION_SCHEMA = (
    "video_id STRING, target_id STRING, start_ms BIGINT, end_ms BIGINT, frame_ids ARRAY<STRING>, text STRING, "
    "tags ARRAY<STRING>, confidence DOUBLE, question STRING, mode STRING, error STRING"
)


def describe_targets(
    targets: DataFrame,
    frames: DataFrame,
    factory: Callable[[], VisualModel],
    question: str | None = None,
    max_frames_per_target: int = 4,
    retries: int = 1,
) -> DataFrame:
    """One description per target; a failing target yields a row with ``error``.

    ``targets``: ``video_id, target_id, start_ms, end_ms, frame_ids``.  Targets
    with more frames than the model takes send evenly spread ones.
    """
    located = targets.select("*", F.posexplode("frame_ids").alias("_pos", "frame_id")).join(
        frames.select("video_id", "frame_id", "image_uri"), ["video_id", "frame_id"]
    )
    requests = located.groupBy("video_id", "target_id", "start_ms", "end_ms").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "frame_id", "image_uri"))).alias("stills")
    )
    mode = "question_conditioned" if question else "general"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        names = [part.split()[0] for part in DESCRIPTION_SCHEMA.replace("ARRAY<STRING>", "A").split(", ")]
        for batch in batches:
            rows = []
            for item in batch.itertuples(index=False):
                stills = spread(list(item.stills), max_frames_per_target)
                ids = [s["frame_id"] for s in stills]
                head = (item.video_id, item.target_id, item.start_ms, item.end_ms, ids)
                try:
                    answer = with_retries(lambda: model.describe([s["image_uri"] for s in stills], question), retries)
                    rows.append((*head, answer["description"], list(answer.get("tags", [])), answer.get("confidence"), question, mode, None))
                except Exception as error:
                    rows.append((*head, None, None, None, question, mode, str(error)))
            yield pd.DataFrame(rows, columns=names)

    return requests.mapInPandas(run, DESCRIPTION_SCHEMA)


def spread(items: list, count: int) -> list:
    """At most ``count`` items, evenly spread (half-even rounding of the positions)."""
    if len(items) <= count:
        return items
    if count == 1:
        return [items[len(items) // 2]]
    return [items[i] for i in sorted({round(k * (len(items) - 1) / (count - 1)) for k in range(count)})]
