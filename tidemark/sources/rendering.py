"""Result rows as plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timecodes import format_timestamp


def time_span(start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), format_timestamp(start), F.lit(" - "), format_timestamp(end), F.lit("]"))


def citation_lines(citations: DataFrame) -> DataFrame:
    """One printable line per citation."""
    line = F.concat_ws(
        " ",
        F.concat(F.lit("- "), time_span(F.col("start_ms"), F.col("end_ms"))),
        F.col("modality"),
        F.col("evidence_id"),
        F.col("excerpt"),
    )
    return citations.select("answer_id", "pos", line.alias("value"))
