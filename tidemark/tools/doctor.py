"""Environment checks before a run."""

from __future__ import annotations

import importlib.util
import os
import shutil
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    message: str


def _program(name: str) -> Check:
    path = shutil.which(name)
    return Check(name, "ok", path) if path else Check(name, "error", f"{name} was not found on PATH")


def _module(label: str, module: str) -> Check:
    found = importlib.util.find_spec(module) is not None
    return Check(label, "ok" if found else "skipped", f"{module} is {'installed' if found else 'not installed'}")


def run_checks(spark: SparkSession, input_root: str, artifact_root: str, model_key_variable: str | None = None) -> list[Check]:
    version = ".".join(map(str, sys.version_info[:3]))
    checks = [
        Check("python", "ok" if sys.version_info >= (3, 11) else "error", version),
        _program("ffmpeg"),
        _program("ffprobe"),
        Check("input_root", *(("ok", input_root) if os.path.isdir(input_root) else ("error", f"not a folder: {input_root}"))),
    ]
    parent = artifact_root if os.path.isdir(artifact_root) else os.path.dirname(os.path.abspath(artifact_root))
    writable = os.access(parent, os.W_OK)
    checks.append(Check("artifact_root", "ok" if writable else "error", artifact_root if writable else f"not writable: {parent}"))
    if model_key_variable:
        known = bool(os.environ.get(model_key_variable, "").strip())
        checks.append(Check("model_key", "ok" if known else "error", f"{model_key_variable} is {'set' if known else 'not set'}"))
    checks.append(_module("ocr", "rapidocr_onnxruntime"))
    checks.append(_module("frames", "cv2"))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    checks.append(Check("checkpoints", "ok" if shared else "warning", shared or "spark.checkpoint.dir is not set"))
    return checks


def report(spark: SparkSession, checks: list[Check]) -> DataFrame:
    return spark.createDataFrame([(c.name, c.status, c.message) for c in checks], "name string, status string, message string")


def is_ok(checks: list[Check]) -> bool:
    return all(check.status != "error" for check in checks)
