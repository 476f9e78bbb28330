"""ffprobe JSON to typed probe rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timecodes import decimal_seconds_to_ms, parse_rational

# Every scalar is read as text first: the tool writes the same field as a JSON
# number or as a quoted number depending on its version.
PAYLOAD_SCHEMA = (
    "format STRUCT<format_name: STRING, format_long_name: STRING, start_time: STRING, "
    "duration: STRING, size: STRING, bit_rate: STRING, probe_score: STRING, tags: MAP<STRING,STRING>>, "
    "streams ARRAY<STRUCT<index: STRING, codec_type: STRING, codec_name: STRING, codec_long_name: STRING, "
    "profile: STRING, width: STRING, height: STRING, r_frame_rate: STRING, avg_frame_rate: STRING, "
    "time_base: STRING, start_time: STRING, duration: STRING, nb_frames: STRING, bit_rate: STRING, "
    "pix_fmt: STRING, sample_aspect_ratio: STRING, display_aspect_ratio: STRING, color_range: STRING, "
    "color_space: STRING, sample_rate: STRING, channels: STRING, channel_layout: STRING, sample_fmt: STRING, "
    "disposition: MAP<STRING,STRING>, tags: MAP<STRING,STRING>, side_data_list: ARRAY<MAP<STRING,STRING>>>>"
)


def _text(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(trimmed != "", trimmed)


def _integer(value: Column) -> Column:
    return F.trim(value).try_cast("bigint")


def _ratio_text(value: Column) -> Column:
    text = _text(value)
    return F.when(~text.isin("N/A", "0:1"), text)


def _flag(disposition: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(disposition, F.lit(name)).isin("1", "true"), F.lit(False))


def _tags(tags: Column) -> Column:
    """Tags as (key, value) pairs sorted by key."""
    pairs = F.array_sort(F.map_entries(tags))
    return F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>"))


def _rotation(stream: Column) -> Column:
    tagged = _integer(F.try_element_at(stream["tags"], F.lit("rotate")))
    sides = F.filter(
        F.transform(stream["side_data_list"], lambda s: _integer(F.try_element_at(s, F.lit("rotation")))),
        lambda r: r.isNotNull(),
    )
    return F.coalesce(F.pmod(F.coalesce(tagged, F.try_element_at(sides, F.lit(1))), F.lit(360)), F.lit(0)).cast("int")


def _common(stream: Column) -> list[Column]:
    return [
        _integer(stream["index"]).cast("int").alias("stream_index"),
        _text(stream["codec_name"]).alias("codec_name"),
        _text(stream["codec_long_name"]).alias("codec_long_name"),
        _text(stream["profile"]).alias("codec_profile"),
        parse_rational(stream["time_base"]).alias("time_base"),
        decimal_seconds_to_ms(stream["start_time"]).alias("start_time_ms"),
        decimal_seconds_to_ms(stream["duration"]).alias("duration_ms"),
        _integer(stream["bit_rate"]).alias("bit_rate"),
        _text(F.try_element_at(stream["tags"], F.lit("language"))).alias("language"),
        _flag(stream["disposition"], "default").alias("is_default"),
        _tags(stream["tags"]).alias("tags"),
    ]


def _video(stream: Column) -> Column:
    return F.struct(
        *_common(stream),
        _integer(stream["width"]).cast("int").alias("width"),
        _integer(stream["height"]).cast("int").alias("height"),
        parse_rational(stream["r_frame_rate"]).alias("frame_rate"),
        parse_rational(stream["avg_frame_rate"]).alias("average_frame_rate"),
        _integer(stream["nb_frames"]).alias("frame_count"),
        _text(stream["pix_fmt"]).alias("pixel_format"),
        _ratio_text(stream["sample_aspect_ratio"]).alias("sample_aspect_ratio"),
        _ratio_text(stream["display_aspect_ratio"]).alias("display_aspect_ratio"),
        _text(stream["color_range"]).alias("color_range"),
        _text(stream["color_space"]).alias("color_space"),
        _rotation(stream).alias("rotation_degrees"),
        _flag(stream["disposition"], "attached_pic").alias("is_attached_picture"),
    )


def _audio(stream: Column) -> Column:
    return F.struct(
        *_common(stream),
        _integer(stream["sample_rate"]).alias("sample_rate_hz"),
        _integer(stream["channels"]).cast("int").alias("channels"),
        _text(stream["channel_layout"]).alias("channel_layout"),
        _text(stream["sample_fmt"]).alias("sample_format"),
    )


def _subtitle(stream: Column) -> Column:
    return F.struct(
        *_common(stream),
        _text(F.try_element_at(stream["tags"], F.lit("title"))).alias("title"),
        _flag(stream["disposition"], "forced").alias("is_forced"),
    )


def map_probes(payloads: DataFrame) -> DataFrame:
    """``video_id, payload`` (JSON text) to container and stream structs.

    ``mapping_error`` names the first unusable required field; such rows keep
    their other columns so a caller can route them.
    """
    # the parser turns broken text into empty structs, so readability is asked separately
    readable = F.json_object_keys("payload").isNotNull()
    parsed = payloads.select("video_id", readable.alias("_readable"), F.from_json("payload", PAYLOAD_SCHEMA).alias("p"))
    streams = F.coalesce(F.col("p.streams"), F.from_json(F.lit("[]"), PAYLOAD_SCHEMA.split("streams ", 1)[1]))

    def of_type(kind: str, build) -> Column:
        return F.transform(F.filter(streams, lambda s: s["codec_type"] == kind), build)

    fmt = F.col("p.format")
    container = F.struct(
        F.coalesce(
            F.filter(F.transform(F.split(fmt["format_name"], ","), lambda n: F.trim(n)), lambda n: n != ""),
            F.array().cast("array<string>"),
        ).alias("format_names"),
        _text(fmt["format_long_name"]).alias("format_long_name"),
        decimal_seconds_to_ms(fmt["start_time"]).alias("start_time_ms"),
        decimal_seconds_to_ms(fmt["duration"]).alias("duration_ms"),
        _integer(fmt["size"]).alias("size_bytes"),
        _integer(fmt["bit_rate"]).alias("bit_rate"),
        _integer(fmt["probe_score"]).cast("int").alias("probe_score"),
        _tags(fmt["tags"]).alias("tags"),
    )
    mapped = parsed.select(
        "video_id",
        "_readable",
        container.alias("container"),
        of_type("video", _video).alias("video_streams"),
        of_type("audio", _audio).alias("audio_streams"),
        of_type("subtitle", _subtitle).alias("subtitle_streams"),
    )
    indexes = F.concat(
        *[F.transform(c, lambda s: s["stream_index"]) for c in ("video_streams", "audio_streams", "subtitle_streams")]
    )
    error = (
        F.when(~F.col("_readable"), "FFprobe payload is not a JSON object.")
        .when(F.exists(indexes, lambda i: i.isNull()), "Missing or invalid stream index.")
        .when(F.exists("video_streams", lambda s: s["width"].isNull()), "Missing or invalid video width.")
        .when(F.exists("video_streams", lambda s: s["height"].isNull()), "Missing or invalid video height.")
        .when(F.size(F.array_distinct(indexes)) < F.size(indexes), "stream indexes must be unique")
    )
    return mapped.withColumn("mapping_error", error).drop("_readable")
