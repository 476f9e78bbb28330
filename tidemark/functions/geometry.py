"""Bounding boxes as ``struct(x, y, width, height)`` in 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_bbox(polygon: Column, width: Column, height: Column) -> Column:
    """Hull of ``array<array<double>>`` points clamped to the frame; NULL when degenerate."""

    def axis(index: int) -> Column:
        return F.transform(polygon, lambda point: point[index])

    def clamp(value: Column, limit: Column) -> Column:
        return F.least(F.greatest(F.lit(0.0), value), limit.cast("double"))

    left, right = clamp(F.array_min(axis(0)), width), clamp(F.array_max(axis(0)), width)
    top, bottom = clamp(F.array_min(axis(1)), height), clamp(F.array_max(axis(1)), height)
    box = F.struct(
        (left / width).alias("x"),
        (top / height).alias("y"),
        ((right - left) / width).alias("width"),
        ((bottom - top) / height).alias("height"),
    )
    return F.when((right > left) & (bottom > top), box)


def bbox_iou(a: Column, b: Column) -> Column:
    left, top = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    right = F.least(a["x"] + a["width"], b["x"] + b["width"])
    bottom = F.least(a["y"] + a["height"], b["y"] + b["height"])
    shared = F.greatest(F.lit(0.0), right - left) * F.greatest(F.lit(0.0), bottom - top)
    union = a["width"] * a["height"] + b["width"] * b["height"] - shared
    return F.when(shared == 0, F.lit(0.0)).otherwise(shared / union)
