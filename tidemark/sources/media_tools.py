"""Running ffprobe, ffmpeg and a frame decoder from tasks.

Each file is one row; the command writes below ``output_root`` under a temporary
name and is renamed when it succeeded, so a retried task leaves no half file.
Missing programs, time-outs and exit codes become an ``error`` value.
"""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Time limits in seconds.
TIMEOUTS = {"probe": 30, "audio": 120, "clip": 120, "subtitles": 60}


def run_command(command: list[str], timeout: int) -> tuple[str, str | None]:
    """Standard output and an error text (None on success)."""
    try:
        done = subprocess.run(command, capture_output=True, timeout=timeout, check=False)
    except FileNotFoundError:
        return "", f"{command[0]} is not installed"
    except subprocess.TimeoutExpired:
        return "", f"{command[0]} exceeded {timeout} s"
    if done.returncode != 0:
        return "", done.stderr.decode("utf-8", "replace").strip()[-500:] or f"exit code {done.returncode}"
    return done.stdout.decode("utf-8", "replace"), None


def probe_files(files: DataFrame, executable: str = "ffprobe") -> DataFrame:
    """``video_id, payload, error`` for ``video_id, uri`` rows; feed to ``map_probes``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item in batch.itertuples(index=False):
                command = [executable, "-v", "error", "-print_format", "json", "-show_format", "-show_streams", item.uri]
                payload, error = run_command(command, TIMEOUTS["probe"])
                rows.append((item.video_id, payload or None, error))
            yield pd.DataFrame(rows, columns=["video_id", "payload", "error"])

    return files.select("video_id", "uri").mapInPandas(run, "video_id STRING, payload STRING, error STRING")


def _seconds(milliseconds: int) -> str:
    return f"{milliseconds / 1000:.3f}"


def audio_arguments(row, rate: int = 16_000, channels: int = 1) -> list[str]:
    return [
        "-ss", _seconds(row.start_ms), "-i", row.uri, "-t", _seconds(row.end_ms - row.start_ms),
        "-map", f"0:{row.stream_index}", "-vn", "-ac", str(channels), "-ar", str(rate), "-c:a", "pcm_s16le",
    ]


def subtitle_arguments(row) -> list[str]:
    return ["-i", row.uri, "-map", f"0:{row.stream_index}", "-f", "webvtt"]


def clip_arguments(row) -> list[str]:
    coding = ["-c:v", "libx264", "-preset", "fast", "-c:a", "aac"] if row.reencode else ["-c", "copy"]
    sound = [] if row.include_audio else ["-an"]
    return ["-ss", _seconds(row.start_ms), "-i", row.uri, "-t", _seconds(row.end_ms - row.start_ms), *coding, *sound]


def derive_files(
    requests: DataFrame,
    arguments: Callable[[object], list[str]],
    output_root: str,
    suffix: str,
    timeout: int,
    executable: str = "ffmpeg",
) -> DataFrame:
    """``request_id, output_uri, error``: one derived file per request row.

    ``requests`` holds ``request_id`` and whatever ``arguments`` reads.  Use with
    :func:`audio_arguments`, :func:`subtitle_arguments` or :func:`clip_arguments`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(output_root, exist_ok=True)
        for batch in batches:
            rows = []
            for item in batch.itertuples(index=False):
                target = os.path.join(output_root, f"{item.request_id}{suffix}")
                partial = os.path.join(output_root, f".{item.request_id}.{uuid.uuid4().hex}{suffix}")
                _, error = run_command([executable, "-y", "-v", "error", *arguments(item), partial], timeout)
                if error is None:
                    os.replace(partial, target)
                rows.append((item.request_id, target if error is None else None, error))
            yield pd.DataFrame(rows, columns=["request_id", "output_uri", "error"])

    return requests.mapInPandas(run, "request_id STRING, output_uri STRING, error STRING")


def decode_frames(requests: DataFrame, output_root: str, jpeg_quality: int = 90) -> DataFrame:
    """Decode ``video_id, uri, timestamp_ms`` rows to JPEG files with a 32 x 32 grey signature.

    Needs OpenCV on the executors.  Feed the rows to ``distinct_frames``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import cv2
        except ImportError:
            cv2 = None
        names = ["video_id", "frame_id", "requested_timestamp_ms", "timestamp_ms", "image_uri", "signature", "error"]
        os.makedirs(output_root, exist_ok=True)
        for batch in batches:
            rows = []
            for item in batch.itertuples(index=False):
                frame_id = f"frame_{item.video_id}_{item.timestamp_ms:012d}"
                head = (item.video_id, frame_id, item.timestamp_ms)
                if cv2 is None:
                    rows.append((*head, None, None, None, "OpenCV is not installed"))
                    continue
                capture = cv2.VideoCapture(item.uri)
                capture.set(cv2.CAP_PROP_POS_MSEC, item.timestamp_ms)
                found, image = capture.read()
                actual = max(0, round(capture.get(cv2.CAP_PROP_POS_MSEC)))
                capture.release()
                if not found:
                    rows.append((*head, None, None, None, "no frame at this time"))
                    continue
                grey = cv2.resize(cv2.cvtColor(image, cv2.COLOR_BGR2GRAY), (32, 32), interpolation=cv2.INTER_AREA)
                target = os.path.join(output_root, f"{frame_id}.jpg")
                cv2.imwrite(target, image, [cv2.IMWRITE_JPEG_QUALITY, jpeg_quality])
                rows.append((*head, actual, target, grey.astype("float32").ravel().tolist(), None))
            yield pd.DataFrame(rows, columns=names)

    schema = (
        "video_id STRING, frame_id STRING, requested_timestamp_ms BIGINT, timestamp_ms BIGINT, "
        "image_uri STRING, signature ARRAY<FLOAT>, error STRING"
    )
    return requests.select("video_id", "uri", "timestamp_ms").mapInPandas(run, schema)
