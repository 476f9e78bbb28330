"""Unit-vector arithmetic on array columns, in double precision and JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def normalize_vector(vector: Column, dimensions: int) -> Column:
    """Unit vector; rows with a wrong length, a zero norm or NaN/inf fail the job."""
    norm = F.sqrt(squared_norm(vector))
    bad = (
        (F.size(vector) != dimensions)
        | (norm == 0)
        | F.isnan(norm)
        | (norm == F.lit(float("inf")))
    )
    message = F.lit(f"embedding vector must hold {dimensions} finite values and not be all zero")
    unit = F.transform(vector, lambda x: x.cast("double") / norm)
    return F.when(bad, F.raise_error(message)).otherwise(unit)


def dot(first: Column, second: Column) -> Column:
    return F.aggregate(F.zip_with(first, second, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def unit_query(vector: list[float], dimensions: int) -> list[float]:
    """Driver-side check and normalisation of one query vector."""
    values = [float(v) for v in vector]
    norm = math.sqrt(sum(v * v for v in values))
    if len(values) != dimensions or not math.isfinite(norm) or norm == 0.0:
        raise ValueError(f"query vector must hold {dimensions} finite values and not be all zero")
    return [v / norm for v in values]
