"""Seconds, timecodes, rationals and index arithmetic with the exact rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimal_seconds_to_ms(text: Column) -> Column:
    """Probe output: decimal seconds to ms, ROUND_HALF_UP; NULL when not a number."""
    seconds = text.try_cast("decimal(30,9)")
    return F.round(seconds * F.lit(1000).cast("decimal(5,0)"), 0).cast("bigint")


def seconds_to_ms(seconds: Column) -> Column:
    """Model output: float seconds to ms, ROUND_HALF_EVEN."""
    return F.bround(seconds.cast("double") * 1000.0, 0).cast("bigint")


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("bigint")


def parse_rational(text: Column) -> Column:
    """``"a/b"`` to ``struct(numerator, denominator)``; NULL unless both are positive."""
    numerator = F.trim(F.split_part(text, F.lit("/"), F.lit(1))).try_cast("int")
    rest = F.substring(text, F.instr(text, "/") + 1, F.length(text))
    denominator = F.trim(rest).try_cast("int")
    usable = text.contains("/") & (numerator > 0) & (denominator > 0)
    return F.when(usable, F.struct(numerator.alias("numerator"), denominator.alias("denominator")))


def rational_value(rational: Column) -> Column:
    return rational["numerator"].cast("double") / rational["denominator"]


def vtt_timestamp_ms(text: Column) -> Column:
    """``[HH:]MM:SS.mmm`` to milliseconds."""
    parts = F.split(text, "[:.]")
    count = F.size(parts)

    def part(offset_from_end: int) -> Column:
        return F.try_element_at(parts, F.lit(-offset_from_end)).try_cast("bigint")

    hours = F.when(count == 4, part(4)).otherwise(F.lit(0).cast("bigint"))
    return hours * 3_600_000 + part(3) * 60_000 + part(2) * 1_000 + part(1)


def format_timestamp(milliseconds: Column) -> Column:
    """``HH:MM:SS.mmm`` as printed in results."""
    value = milliseconds.cast("bigint")

    def div(divisor: int) -> Column:
        return F.floor(value / F.lit(divisor)).cast("bigint")

    return F.format_string(
        "%02d:%02d:%02d.%03d",
        div(3_600_000),
        F.pmod(div(60_000), F.lit(60)),
        F.pmod(div(1_000), F.lit(60)),
        F.pmod(value, F.lit(1_000)),
    )
