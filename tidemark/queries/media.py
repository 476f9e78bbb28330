"""Probe mapping, validation rules, subtitles, speech, on-screen text and text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.completions import parse_completion, response_problems
from tidemark.functions.keys import catalog_key_name, redact_map, stable_id
from tidemark.functions.text import normalize_compat, plain_text
from tidemark.functions.timecodes import decimal_seconds_to_ms, format_timestamp, seconds_to_ms
from tidemark.operators import media, screen_text
from tidemark.queries import query
from tidemark.queries.sql import IV
from tidemark.session import read_table
from tidemark.sources.ffprobe import map_probes
from tidemark.sources.trace import trace_events
from tidemark.sources.webvtt import parse_vtt
from tidemark.sources.workload import event_intervals


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probe payload per part: a video stream, sometimes a cover picture, audio, subtitles."""
    size = F.col("p_size")

    def stream(**fields: Column) -> Column:
        names = (
            "index", "codec_type", "codec_name", "width", "height", "r_frame_rate", "avg_frame_rate",
            "duration", "sample_rate", "channels", "disposition", "tags",
        )
        types = {"disposition": "struct<default:int,attached_pic:int>", "tags": "map<string,string>"}
        return F.struct(
            *[fields.get(n, F.lit(None)).cast(types.get(n, "string")).alias(n) for n in names]
        )

    def disposition(default: int, picture: int) -> Column:
        return F.struct(F.lit(default).alias("default"), F.lit(picture).alias("attached_pic"))

    cover = stream(
        index=F.lit(9), codec_type=F.lit("video"), codec_name=F.lit("mjpeg"), width=F.lit(64), height=F.lit(64),
        disposition=disposition(0, 1),
    )
    video = stream(
        index=F.lit(0),
        codec_type=F.lit("video"),
        codec_name=F.lower("p_type"),
        width=size * 64,
        height=size * 36,
        r_frame_rate=F.concat(size, F.lit("000/1001")),
        avg_frame_rate=F.when(size > 40, F.lit("0/0")).otherwise(F.concat(size * 1_000, F.lit("/"), F.lit(1_001) + (size > 20).cast("int"))),
        duration=F.format_string("%.4f", F.col("p_retailprice") / 8),
        disposition=disposition(1, 0),
        tags=F.create_map(F.lit("rotate"), (size * 45 - 900).cast("string")),
    )
    audio = stream(
        index=F.lit(1), codec_type=F.lit("audio"), codec_name=F.lit("aac"), sample_rate=F.lit(48_000), channels=F.lit(2),
        tags=F.create_map(F.lit("language"), F.lit("en")),
    )
    subtitles = stream(index=F.lit(2), codec_type=F.lit("subtitle"), codec_name=F.lit("mov_text"))
    streams = F.array_compact(
        F.array(
            F.when(F.col("p_brand") == "Brand#1", cover),
            F.when(size > 2, video),
            F.when(size <= 30, audio),
            F.when(F.col("p_type") == "SMALL", subtitles),
        )
    )
    container = F.struct(
        F.when(size < 45, F.lit("mov,mp4 , m4a")).alias("format_name"),
        F.when(size < 48, F.format_string("%.4f", F.col("p_retailprice") / 8)).alias("duration"),
        F.col("p_partkey").cast("string").alias("size"),
    )
    payload = F.to_json(F.struct(container.alias("format"), streams.alias("streams")))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), payload.alias("payload"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_flags(media.with_primaries(map_probes(_payloads(spark, sf_dir))))


_PARTS = """pr AS (
  SELECT p_partkey AS video_id, p_size AS s, p_brand, lower(p_type) AS codec, p_type,
         CAST(round(CAST(format('{:.4f}', p_retailprice / 8) AS DECIMAL(30,9)) * 1000, 0) AS BIGINT) AS ms,
         p_size > 2 AS has_video, p_size <= 30 AS has_audio
  FROM part)"""


@query(f"""WITH {_PARTS}
SELECT video_id, CASE WHEN s < 48 THEN ms ELSE -1 END AS duration_ms, CASE WHEN s < 45 THEN 'mov|mp4|m4a' ELSE '' END AS format_names,
  (CASE WHEN has_video THEN 1 ELSE 0 END + CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END) AS n_video, CASE WHEN has_audio THEN 1 ELSE 0 END AS n_audio,
  CAST(CASE WHEN has_video THEN s * 64 ELSE -1 END AS BIGINT) AS width, CASE WHEN has_video THEN codec ELSE '' END AS codec_name,
  CAST(CASE WHEN has_video AND s <= 40 THEN s * 1000 ELSE -1 END AS BIGINT) AS average_numerator,
  CAST(CASE WHEN has_video THEN ((s * 45 - 900) % 360 + 360) % 360 ELSE -1 END AS BIGINT) AS rotation_degrees,
  CASE WHEN s < 48 THEN ms WHEN has_video THEN ms ELSE -1 END AS source_end_ms
FROM pr""")
def ffprobe_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _probes(spark, sf_dir)
    sources = media.source_range(probes)
    video = F.col("primary_video")

    def number(value: Column) -> Column:
        return F.coalesce(value.cast("bigint"), F.lit(-1).cast("bigint"))

    return probes.join(sources, "video_id").select(
        "video_id",
        number(F.col("container.duration_ms")).alias("duration_ms"),
        F.array_join("container.format_names", "|").alias("format_names"),
        F.size("video_streams").alias("n_video"),
        F.size("audio_streams").alias("n_audio"),
        number(video["width"]).alias("width"),
        F.coalesce(video["codec_name"], F.lit("")).alias("codec_name"),
        number(video["average_frame_rate"]["numerator"]).alias("average_numerator"),
        number(video["rotation_degrees"]).alias("rotation_degrees"),
        number(F.col("source_end_ms")).alias("source_end_ms"),
    )


@query(f"""WITH {_PARTS},
i AS (SELECT *, CASE WHEN NOT has_video THEN ['NO_VIDEO_STREAM'] ELSE list_filter([
    CASE WHEN codec NOT IN ('economy', 'standard', 'small') THEN 'UNSUPPORTED_VIDEO_CODEC' END,
    CASE WHEN s <= 40 AND s > 20 AND abs(s * 1000 / 1001::DOUBLE - s * 1000 / 1002::DOUBLE) > 0.001 THEN 'VARIABLE_FRAME_RATE' END,
    CASE WHEN ((s * 45 - 900) % 360 + 360) % 360 <> 0 THEN 'ROTATION_METADATA_PRESENT' END,
    CASE WHEN s * 64 > 1920 THEN 'VIDEO_WIDTH_EXCEEDED' END,
    CASE WHEN ms > 120000 THEN 'VIDEO_DURATION_EXCEEDED' END,
    CASE WHEN NOT has_audio THEN 'NO_AUDIO_STREAM' END,
    CASE WHEN s >= 45 THEN 'UNKNOWN_CONTAINER_FORMAT' END], lambda x: x IS NOT NULL) END AS issues FROM pr)
SELECT video_id, array_to_string(issues, ',') AS issues,
  CASE WHEN list_has_any(issues, ['NO_VIDEO_STREAM', 'UNSUPPORTED_VIDEO_CODEC', 'VIDEO_DURATION_EXCEEDED']) THEN 'invalid'
       WHEN list_contains(issues, 'VIDEO_WIDTH_EXCEEDED') THEN 'requires_normalization'
       WHEN len(issues) > 0 THEN 'valid_with_warnings' ELSE 'valid' END AS validation_status,
  CASE WHEN list_has_any(issues, ['NO_VIDEO_STREAM', 'UNSUPPORTED_VIDEO_CODEC', 'VIDEO_DURATION_EXCEEDED']) THEN 'reject'
       WHEN list_contains(issues, 'VIDEO_WIDTH_EXCEEDED') THEN 'normalize_and_reinspect' ELSE 'proceed' END AS next_action
FROM i""")
def media_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = media.MediaPolicy(
        max_width=1_920, max_duration_ms=120_000, supported_video_codecs=("economy", "standard", "small")
    )
    checked = media.with_issues(_probes(spark, sf_dir), policy)
    return checked.select(
        "video_id",
        F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("issues"),
        "validation_status",
        "next_action",
    )


@query(f"""WITH {_PARTS}
SELECT video_id, has_video, has_audio, p_type = 'SMALL' AS has_embedded_subtitles, has_video AND p_brand = 'Brand#1' AS has_multiple_video_streams,
  has_video AND s <= 40 AND abs(s * 1000 / 1001::DOUBLE - s * 1000 / (1001 + CASE WHEN s > 20 THEN 1 ELSE 0 END)::DOUBLE) > 0.001 AS is_variable_frame_rate,
  has_video AND ((s * 45 - 900) % 360 + 360) % 360 <> 0 AS has_rotation_metadata FROM pr""")
def media_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probes(spark, sf_dir).select(
        "video_id", "has_video", "has_audio", "has_embedded_subtitles", "has_multiple_video_streams",
        "is_variable_frame_rate", "has_rotation_metadata",
    )


@query(f"""WITH {_PARTS}
SELECT video_id, 'video' AS kind, 9 AS stream_index, 64 AS width, '' AS language FROM pr WHERE p_brand = 'Brand#1'
UNION ALL SELECT video_id, 'video', 0, s * 64, '' FROM pr WHERE has_video
UNION ALL SELECT video_id, 'audio', 1, -1, 'en' FROM pr WHERE has_audio
UNION ALL SELECT video_id, 'subtitle', 2, -1, '' FROM pr WHERE p_type = 'SMALL'""")
def stream_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stream_summaries(_probes(spark, sf_dir)).select(
        "video_id",
        "kind",
        "stream_index",
        F.coalesce("width", F.lit(-1)).alias("width"),
        F.coalesce("language", F.lit("")).alias("language"),
    )


# ---- subtitles: every line of a turn becomes a cue of that turn's file ------

@query("""WITH l AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM conversations)
SELECT concat_ws('_', conv_id, turn) AS video_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY line_no) - 1 AS ord,
       line_no * 61500 AS start_ms, line_no * 61500 + 900 AS end_ms, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS normalized_text
FROM l WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''""")
def vtt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    cues = F.transform(
        F.split(escaped, "\n"),
        lambda line, i: F.concat(
            F.lit("cue "), i.cast("string"), F.lit("\n"),
            format_timestamp(i.cast("bigint") * 61_500), F.lit(" --> "), format_timestamp(i.cast("bigint") * 61_500 + 900), F.lit(" align:start\n<v "),
            F.col("role"), F.lit(">"), line, F.lit("</v>"),
        ),
    )
    files = turns.select(
        F.concat_ws("_", "conv_id", "turn").alias("video_id"),
        F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, "\n\n")).alias("text"),
    )
    return parse_vtt(files, language="en", stream_index=2).select(
        "video_id", "ord", "start_ms", "end_ms", "normalized_text"
    )


_ASR = """a AS (
  SELECT conv_id AS video_id, turn AS ord, text, turn * 3.0005::DOUBLE AS s, turn * 3.0005::DOUBLE + length(text) / 256.0::DOUBLE AS e FROM conversations),
r AS (SELECT conv_id AS video_id, 10000 AS lo, 10000 + count(*) * 2500 AS hi FROM conversations GROUP BY conv_id),
t AS (SELECT a.*, lo, hi, greatest(lo, lo + CAST(round_even(s * 1000.0, 0) AS BIGINT)) AS start_ms, least(hi, lo + CAST(round_even(e * 1000.0, 0) AS BIGINT)) AS end_ms
  FROM a JOIN r USING (video_id) WHERE e > s)"""


@query(f"""WITH {_ASR}
SELECT video_id, ord, start_ms, end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS normalized_text,
  CASE WHEN start_ms < least(end_ms, start_ms + 400) THEN 1 ELSE 0 END AS n_words, 0.75::DOUBLE AS confidence
FROM t WHERE start_ms < end_ms""")
def asr_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    start = F.col("turn") * F.lit(3.0005)
    words = F.array(
        F.struct(F.lit(" word ").alias("text"), start.alias("start_seconds"), (start + 0.4).alias("end_seconds"), F.lit(0.75).alias("probability")),
        F.struct(F.lit("   ").alias("text"), start.alias("start_seconds"), (start + 0.4).alias("end_seconds"), F.lit(0.1).alias("probability")),
    )
    recognised = turns.select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("ord"),
        "text",
        start.alias("start_seconds"),
        (start + F.length("text") / F.lit(256.0)).alias("end_seconds"),
        words.alias("words"),
    )
    audio = turns.groupBy(F.col("conv_id").alias("video_id")).agg(
        F.lit(10_000).cast("bigint").alias("source_start_ms"), (10_000 + F.count(F.lit(1)) * 2_500).alias("source_end_ms")
    )
    return media.speech_segments(recognised, audio).select(
        "video_id", "ord", "start_ms", "end_ms", "normalized_text", F.size("words").alias("n_words"), "confidence"
    )


# ---- on-screen text ---------------------------------------------------------

_DETECTED = """dt AS (
  SELECT l_orderkey AS video_id, l_linenumber AS detection_no, l_suppkey AS frame_id, 1 - l_discount * 8 AS confidence, l_returnflag, l_linestatus,
         l_quantity * 20 - 100 AS x0, l_quantity * 30 + 10 AS x1, l_tax * 5000 AS y0, l_tax * 9000 + l_quantity AS y1
  FROM lineitem)"""


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, tax = F.col("l_quantity"), F.col("l_tax")
    x0, x1, y0, y1 = q * 20 - 100, q * 30 + 10, tax * 5_000, tax * 9_000 + q
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"),
        F.col("l_suppkey").alias("frame_id"),
        F.col("l_linenumber").alias("detection_no"),
        F.concat(F.lit(" "), "l_returnflag", F.lit("　"), F.translate("l_linestatus", "FO", "ＦＯ"), F.lit("  ")).alias("text"),
        F.array(F.array(x1, y0), F.array(x0, y0), F.array(x0, y1), F.array(x1, y1)).alias("polygon"),
        (1 - F.col("l_discount") * 8).alias("confidence"),
        F.lit(1_000).alias("width"),
        F.lit(400).alias("height"),
    )


@query(f"""WITH {_DETECTED}, c AS (
  SELECT *, least(greatest(0, x0), 1000) AS l, least(greatest(0, x1), 1000) AS r, least(greatest(0, y0), 400) AS t, least(greatest(0, y1), 400) AS b FROM dt WHERE confidence >= 0.5)
SELECT video_id, frame_id, detection_no, l_returnflag || ' ' || l_linestatus AS normalized_text,
  round(l / 1000, 6) AS x, round(t / 400, 6) AS y, round((r - l) / 1000, 6) AS width, round((b - t) / 400, 6) AS height
FROM c WHERE r > l AND b > t""")
def ocr_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    detections = _detections(spark, sf_dir)
    stills = detections.select("video_id", "frame_id").distinct().withColumn("timestamp_ms", F.col("frame_id"))
    observed = screen_text.observations(detections, stills)
    return observed.select(
        "video_id",
        "frame_id",
        F.element_at(F.split("observation_id", "_"), -1).cast("int").alias("detection_no"),
        "normalized_text",
        *[F.round(F.col("bbox")[n], 6).alias(n) for n in ("x", "y", "width", "height")],
    )


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS video_id, l_suppkey AS frame_id FROM lineitem WHERE l_quantity <= 35),
r AS (SELECT l_orderkey AS video_id, l_suppkey AS frame_id FROM lineitem WHERE l_returnflag <> 'N'),
c AS (SELECT video_id, frame_id, count(*) AS n FROM r GROUP BY ALL)
SELECT video_id, frame_id, 'duplicate' AS problem FROM c WHERE n > 1
UNION ALL SELECT video_id, frame_id, 'unknown' FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.video_id = c.video_id AND f.frame_id = c.frame_id)
UNION ALL SELECT video_id, frame_id, 'missing' FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE f.video_id = c.video_id AND f.frame_id = c.frame_id)""")
def ocr_result_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    pair = [F.col("l_orderkey").alias("video_id"), F.col("l_suppkey").alias("frame_id")]
    stills = lines.where("l_quantity <= 35").select(*pair).distinct()
    return screen_text.check_results(lines.where("l_returnflag <> 'N'").select(*pair), stills)


def _line_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as on-screen text: three places, three lines a second."""
    lines = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    slot = (F.col("line_no") % 3).cast("double")
    return lines.where("trim(line) <> ''").select(
        "video_id",
        F.format_string("obs_%06d", "line_no").alias("observation_id"),
        F.concat_ws("_", F.lit("frame"), F.floor(F.col("line_no") / 3)).alias("frame_id"),
        (F.floor(F.col("line_no") / 3) * 1_000).alias("timestamp_ms"),
        normalize_compat(F.col("line")).alias("normalized_text"),
        F.struct(
            F.lit(0.1).alias("x"), (slot * 0.3).alias("y"), F.lit(0.8).alias("width"), F.lit(0.25).alias("height")
        ).alias("bbox"),
        (F.lit(1.0) / (F.length("line") % 7 + 1)).alias("confidence"),
    )


def _track_spans(observed: DataFrame, params: screen_text.OcrParams) -> DataFrame:
    spans = screen_text.text_spans(screen_text.assign_tracks(observed, params), params, with_ids=False)
    return spans.select("video_id", "span_id", "start_ms", "end_ms", "text", F.round("confidence", 9).alias("confidence"), "occurrences")


@query()
def ocr_track_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar text in the same place merges."""
    return _track_spans(_line_observations(spark, sf_dir), screen_text.OcrParams())


@query("""WITH l AS (SELECT doc_id AS video_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
o AS (SELECT video_id, n, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t, n % 3 AS slot, (n // 3) * 1000 AS ts, 1.0::DOUBLE / (length(line) % 7 + 1) AS conf FROM l WHERE trim(line) <> ''),
b AS (SELECT *, lag(ts) OVER (PARTITION BY video_id, lower(t), slot ORDER BY ts) AS before FROM o),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > 1500 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, lower(t), slot ORDER BY ts) AS track FROM b)
SELECT video_id, 'span_obs_' || lpad(CAST(min(n) AS VARCHAR), 6, '0') AS span_id, min(ts) AS start_ms, max(ts) + 1 AS end_ms, first(t ORDER BY conf DESC, ts, n) AS text,
  round(avg(conf), 9) AS confidence, count(*) AS occurrences FROM g GROUP BY video_id, lower(t), slot, track""")
def ocr_equal_text_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only equal text in the same place merges."""
    return _track_spans(_line_observations(spark, sf_dir), screen_text.OcrParams(min_text_similarity=1.0))


# ---- scalar helpers ---------------------------------------------------------

@query("""WITH x AS (SELECT p_partkey, format('{:.5f}', p_retailprice / 8) AS text, CAST(format('{:.5f}', p_retailprice / 8) AS DOUBLE) AS number FROM part)
SELECT p_partkey, CAST(round(CAST(text AS DECIMAL(30,9)) * 1000, 0) AS BIGINT) AS half_up_ms, CAST(round_even(number * 1000.0, 0) AS BIGINT) AS half_even_ms FROM x""")
def seconds_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two ways seconds become milliseconds."""
    text = F.format_string("%.5f", F.col("p_retailprice") / 8)
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        decimal_seconds_to_ms(text).alias("half_up_ms"),
        seconds_to_ms(text.cast("double")).alias("half_even_ms"),
    )


@query(f"""WITH {IV}, h AS (SELECT video_id, min(start_ms) AS lo FROM iv GROUP BY video_id), o AS (SELECT event_id, start_ms - lo AS ms FROM iv JOIN h USING (video_id))
SELECT event_id, format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS rendered FROM o""")
def rendered_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    first = iv.groupBy("video_id").agg(F.min("start_ms").alias("lo"))
    return iv.join(first, "video_id").select("event_id", format_timestamp(F.col("start_ms") - F.col("lo")).alias("rendered"))


@query("""SELECT o_orderkey, 'evidence_' || substr(sha256('["' || o_custkey || '","' || o_orderpriority || '"]'), 1, 24) AS stable_id,
  'index:' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ':bm25' END || ':primary' AS key_name FROM orders""")
def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") != "F", F.lit("bm25"))
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        stable_id("evidence", F.col("o_custkey"), F.col("o_orderpriority")).alias("stable_id"),
        catalog_key_name(F.lit("index"), F.lit("primary"), modality=F.col("o_orderpriority"), index_kind=kind).alias("key_name"),
    )


@query("""SELECT conv_id, turn, '[REDACTED]' AS api_key, text AS message, '[REDACTED]' AS session_secret, role AS role FROM conversations""")
def trace_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    payload = redact_map(
        F.create_map(
            F.lit("X-Api-Key"), F.col("text"), F.lit("message"), F.col("text"), F.lit("session secret"), F.col("text"), F.lit("role"), F.col("role")
        )
    )
    return turns.withColumn("p", payload).select(
        "conv_id", "turn", F.col("p")["X-Api-Key"].alias("api_key"), F.col("p")["message"].alias("message"),
        F.col("p")["session secret"].alias("session_secret"), F.col("p")["role"].alias("role"),
    )


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
  epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS elapsed_ms, event_type AS type FROM events""")
def trace_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("recorded_at"),
        F.col("event_type").alias("type"),
        F.create_map(F.lit("event_id"), F.col("event_id").cast("string")).alias("payload"),
    )
    return trace_events(events).select(
        F.col("payload")["event_id"].cast("bigint").alias("event_id"), "sequence", "elapsed_ms", "type"
    )


@query("""SELECT doc_id, trim(lang || ' text') AS description, CASE WHEN lang = source THEN lang ELSE lang || ',' || source END AS tags,
  CASE WHEN n_chars <= 2000 THEN n_chars / 2000.0::DOUBLE ELSE -1 END AS confidence FROM documents""")
def completion_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers, half of them in a code fence, with untidy tags and confidences."""
    body = F.to_json(
        F.struct(
            F.concat(F.lit("  "), "lang", F.lit(" text ")).alias("description"),
            F.array(F.col("lang"), F.concat(F.lit(" "), "source"), F.lit("  "), F.concat("lang", F.lit(" "))).alias("tags"),
            (F.col("n_chars") / F.lit(2000.0)).alias("confidence"),
        )
    )
    content = F.when(F.col("lang") == "en", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    parsed = read_table(spark, sf_dir, "documents").withColumn("c", parse_completion(content))
    return parsed.select(
        "doc_id", "c.description", F.array_join("c.tags", ",").alias("tags"), F.coalesce("c.confidence", F.lit(-1.0)).alias("confidence")
    )


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS request_id, l_partkey AS target_id FROM lineitem WHERE l_linenumber <= 4),
o AS (SELECT l_orderkey AS request_id, l_partkey AS target_id, l_shipdate, CASE WHEN l_tax = 0 THEN '' ELSE 'x' END AS text, l_discount * 12 AS confidence, l_quantity FROM lineitem),
c AS (SELECT request_id, target_id, count(*) AS n FROM o GROUP BY ALL)
SELECT o.request_id, o.target_id, CASE WHEN t.request_id IS NULL THEN 'unknown_target' WHEN n > 1 THEN 'duplicate_target' WHEN text = '' THEN 'empty_text'
  WHEN l_quantity > 45 THEN 'foreign_frames' WHEN confidence > 1 THEN 'confidence_out_of_range' END AS problem
FROM o JOIN c USING (request_id, target_id) LEFT JOIN t USING (request_id, target_id)
WHERE t.request_id IS NULL OR n > 1 OR text = '' OR l_quantity > 45 OR confidence > 1""")
def completion_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    pair = [F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("target_id")]
    own = F.concat(F.lit("frame_"), F.col("l_partkey"))
    targets = lines.where("l_linenumber <= 4").select(*pair, F.array(own).alias("frame_ids")).distinct()
    answers = lines.select(
        *pair,
        F.when(F.col("l_tax") == 0, F.lit(" ")).otherwise(F.lit("x")).alias("text"),
        F.when(F.col("l_quantity") > 45, F.array(own, F.lit("other"))).otherwise(F.array(own)).alias("frame_ids"),
        F.array(F.col("l_returnflag")).alias("tags"),
        (F.col("l_discount") * 12).alias("confidence"),
    )
    return response_problems(answers, targets)


# the character references that the pages hold; a reference may lack its semicolon, and ampersands come last
_REFERENCES = (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&amp;?", "&"))


def _plain_sql(markup: str) -> str:
    text = f"regexp_replace({markup}, '<[^>]+>', '', 'g')"
    for pattern, character in _REFERENCES:
        text = f"regexp_replace({text}, '{pattern}', '{character}', 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_plain_sql('html')} AS text FROM pages")
def page_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup stripped, entities decoded, white space collapsed, over whole pages."""
    return read_table(spark, sf_dir, "pages").select("page_id", plain_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents""")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility folding leaves these texts alone but for white space."""
    return read_table(spark, sf_dir, "documents").select("doc_id", normalize_compat(F.col("text")).alias("text"))
