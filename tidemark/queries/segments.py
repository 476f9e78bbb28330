"""Chunking, inspection ranges, shots and timeline context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import ends_sentence
from tidemark.operators import chunking, context, frames, ranges
from tidemark.plans.ordered import ordered, running
from tidemark.queries import query
from tidemark.queries.sql import CHUNKS, LINES, SEGS, chunk_fold, grid_shots, merged
from tidemark.session import read_table
from tidemark.sources.workload import conversation_segments, document_lines
from tidemark.sources.workload import grid_shots as make_shots

# Turns are long, so chunks of a conversation get larger character limits.
TURN_CHUNKS = chunking.ChunkParams(target_characters=600, max_characters=2_000)
_TURN_SQL = chunk_fold(15_000, 30_000, 600, 2_000, 2_500)
_LINE_SQL = chunk_fold(15_000, 30_000, 240, 480, 2_500)


@query(f"""WITH RECURSIVE {SEGS}, {_TURN_SQL}
SELECT video_id, chunk_no, min_by(start_ms, ord) AS start_ms, max_by(end_ms, ord) AS end_ms,
       count(*) AS n_segments, CAST(sum(length(seg_text)) AS BIGINT) AS n_chars
FROM labelled GROUP BY video_id, chunk_no""")
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_sizes(conversation_segments(spark, sf_dir), TURN_CHUNKS)


@query(f"""WITH RECURSIVE {LINES}, {_LINE_SQL}
SELECT video_id, chunk_no, min_by(start_ms, ord) AS start_ms, max_by(end_ms, ord) AS end_ms,
       count(*) AS n_segments, CAST(sum(length(seg_text)) AS BIGINT) AS n_chars
FROM labelled GROUP BY video_id, chunk_no""")
def greedy_chunks_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a subtitle track, default limits."""
    return _chunk_sizes(document_lines(spark, sf_dir), chunking.ChunkParams())


def _chunk_sizes(segments: DataFrame, params: chunking.ChunkParams) -> DataFrame:
    needed = segments.select("video_id", "ord", "start_ms", "end_ms", "normalized_text")
    labelled = chunking.assign_chunks(needed, params)
    return labelled.groupBy("video_id", "chunk_no").agg(
        F.min_by("start_ms", "ord").alias("start_ms"),
        F.max_by("end_ms", "ord").alias("end_ms"),
        F.count(F.lit(1)).alias("n_segments"),
        F.sum(F.length("normalized_text")).alias("n_chars"),
    )


@query(f"""WITH RECURSIVE {SEGS}, {_TURN_SQL}, {CHUNKS}
SELECT video_id, ord, start_ms, end_ms, segment_ids, text, end_ms - start_ms > 30000 AS oversized FROM chunks""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.build_chunks(conversation_segments(spark, sf_dir), TURN_CHUNKS)
    return chunks.select(
        "video_id", "ord", "start_ms", "end_ms", F.array_join("segment_ids", ",").alias("segment_ids"), "text", "oversized"
    )


def _sources(segments: DataFrame) -> DataFrame:
    return segments.groupBy("video_id").agg(
        F.lit(0).cast("bigint").alias("source_start_ms"), (F.max("end_ms") + 100).alias("source_end_ms")
    )


@query(f"""WITH RECURSIVE {SEGS}, {_TURN_SQL}, {CHUNKS}, {grid_shots('segs')},
src AS (SELECT video_id, max(end_ms) + 100 AS hi FROM segs GROUP BY video_id),
pair AS (
  SELECT c.video_id, c.ord, c.start_ms AS c_s, c.end_ms AS c_e, hi, s.ord AS s_ord, s.shot_id, s.start_ms AS s_s, s.end_ms AS s_e,
         s.start_ms < c.end_ms AND c.start_ms < s.end_ms AS required
  FROM chunks c JOIN src USING (video_id)
  JOIN shots s ON s.video_id = c.video_id AND s.start_ms < least(hi, c.end_ms + 4000) AND greatest(0, c.start_ms - 4000) < s.end_ms),
base AS (
  SELECT video_id, ord, min(s_s) FILTER (WHERE required) AS lo, max(s_e) FILTER (WHERE required) AS hi2 FROM pair GROUP BY video_id, ord),
opt AS (
  SELECT p.*, row_number() OVER (PARTITION BY video_id, ord ORDER BY s_ord) AS k FROM pair p WHERE NOT required),
walk AS (
  SELECT video_id, ord, CAST(0 AS BIGINT) AS k, lo, hi2, CAST(NULL AS BIGINT) AS took FROM base
  UNION ALL
  SELECT w.video_id, w.ord, o.k,
         CASE WHEN greatest(w.hi2, o.s_e) - least(w.lo, o.s_s) <= 31000 THEN least(w.lo, o.s_s) ELSE w.lo END,
         CASE WHEN greatest(w.hi2, o.s_e) - least(w.lo, o.s_s) <= 31000 THEN greatest(w.hi2, o.s_e) ELSE w.hi2 END,
         CASE WHEN greatest(w.hi2, o.s_e) - least(w.lo, o.s_s) <= 31000 THEN o.s_ord END
  FROM walk w JOIN opt o ON o.video_id = w.video_id AND o.ord = w.ord AND o.k = w.k + 1),
kept AS (
  SELECT video_id, ord, s_ord, shot_id, s_s, s_e FROM pair p
  WHERE required OR EXISTS (SELECT 1 FROM walk w WHERE w.video_id = p.video_id AND w.ord = p.ord AND w.took = p.s_ord))
SELECT c.video_id, c.ord, string_agg(k.shot_id, ',' ORDER BY k.s_s) AS shot_ids,
       greatest(0, least(min(c.start_ms), min(k.s_s))) AS insp_start_ms,
       least(min(hi), greatest(max(c.end_ms), max(k.s_e))) AS insp_end_ms
FROM chunks c JOIN src USING (video_id) JOIN kept k ON k.video_id = c.video_id AND k.ord = c.ord
GROUP BY c.video_id, c.ord""")
def inspection_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = chunking.ChunkParams(
        target_characters=600, max_characters=2_000, context_padding_ms=4_000, max_inspection_duration_ms=31_000
    )
    segments = conversation_segments(spark, sf_dir)
    chunks = chunking.build_chunks(segments, params, _sources(segments))
    inspected = chunking.with_inspection(chunks, make_shots(segments), params)
    return inspected.select(
        "video_id", "ord", F.array_join("shot_ids", ",").alias("shot_ids"), "insp_start_ms", "insp_end_ms"
    )


@query(f"""WITH RECURSIVE {SEGS}, {_TURN_SQL}, {CHUNKS}, src AS (SELECT video_id, max(end_ms) + 100 AS hi FROM segs GROUP BY video_id)
SELECT video_id, ord,
       CASE WHEN least(hi, end_ms + 500) - greatest(0, start_ms - 500) > 60000 THEN start_ms ELSE greatest(0, start_ms - 500) END AS insp_start_ms,
       CASE WHEN least(hi, end_ms + 500) - greatest(0, start_ms - 500) > 60000 THEN end_ms ELSE least(hi, end_ms + 500) END AS insp_end_ms
FROM chunks JOIN src USING (video_id)""")
def inspection_range_without_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = conversation_segments(spark, sf_dir)
    chunks = chunking.build_chunks(segments, TURN_CHUNKS, _sources(segments))
    return chunking.with_inspection(chunks, None, TURN_CHUNKS).select(
        "video_id", "ord", "insp_start_ms", "insp_end_ms"
    )


@query(f"""WITH {SEGS}, {grid_shots('segs')}, src AS (SELECT video_id, min(start_ms) + 1500 AS lo, max(end_ms) - 700 AS hi FROM segs GROUP BY video_id)
SELECT video_id, ord AS shot_ord, greatest(start_ms, lo) AS start_ms, least(end_ms, hi) AS end_ms, shot_id AS shot_ids
FROM shots JOIN src USING (video_id) WHERE greatest(start_ms, lo) < least(end_ms, hi)""")
def shot_fallback_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = conversation_segments(spark, sf_dir)
    sources = segments.groupBy("video_id").agg(
        (F.min("start_ms") + 1_500).alias("source_start_ms"), (F.max("end_ms") - 700).alias("source_end_ms")
    )
    chunks = chunking.shot_fallback_chunks(make_shots(segments), sources)
    return chunks.select("video_id", "shot_ord", "start_ms", "end_ms", F.array_join("shot_ids", ",").alias("shot_ids"))


@query("""WITH c AS (
  SELECT conv_id AS video_id, turn AS ord, CAST(round_even(turn * 5.0005::DOUBLE * 1000.0, 0) AS BIGINT) AS s,
         greatest(CAST(round_even(turn * 5.0005::DOUBLE * 1000.0, 0) AS BIGINT) + 1,
                  CAST(round_even((turn * 5.0005::DOUBLE + length(text) / 512.0::DOUBLE) * 1000.0, 0) AS BIGINT)) AS e
  FROM conversations),
r AS (SELECT conv_id AS video_id, 5100 AS lo, 5100 + count(*) * 2500 AS hi FROM conversations GROUP BY conv_id),
k AS (SELECT video_id, ord, greatest(s, lo) AS start_ms, least(e, hi) AS end_ms FROM c JOIN r USING (video_id)
      WHERE greatest(s, lo) < least(e, hi))
SELECT * FROM k
UNION ALL
SELECT video_id, 0, lo, hi FROM r WHERE video_id NOT IN (SELECT video_id FROM k)""")
def shot_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    start = F.col("turn") * F.lit(5.0005)
    cuts = turns.select(
        F.col("conv_id").alias("video_id"),
        F.col("turn").alias("ord"),
        start.alias("start_seconds"),
        (start + F.length("text") / F.lit(512.0)).alias("end_seconds"),
    )
    sources = turns.groupBy(F.col("conv_id").alias("video_id")).agg(
        F.lit(5_100).cast("bigint").alias("source_start_ms"), (5_100 + F.count(F.lit(1)) * 2_500).alias("source_end_ms")
    )
    return chunking.detected_shots(cuts, sources)


@query(f"""WITH {SEGS}, p AS (SELECT *, lag(end_ms) OVER (PARTITION BY video_id ORDER BY ord) AS before FROM segs)
SELECT video_id, ord, coalesce(greatest(0, start_ms - before), -1) AS silence_ms,
       regexp_matches(seg_text, '[.!?。！？；;]["''”’）)]?$') AS ends_sentence, length(seg_text) AS n_chars
FROM p""")
def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence before a segment and whether it ends a sentence."""
    scan = running(
        ordered(conversation_segments(spark, sf_dir), ["video_id"], ["ord"]),
        {"before": ("last", F.col("end_ms"))},
        inclusive=False,
    )
    return scan.done().select(
        "video_id",
        "ord",
        F.coalesce(F.greatest(F.lit(0), F.col("start_ms") - F.col("before")), F.lit(-1)).alias("silence_ms"),
        ends_sentence(F.col("normalized_text")).alias("ends_sentence"),
        F.length("normalized_text").cast("bigint").alias("n_chars"),
    )


# ---- timeline context: every turn is a chunk, system turns are the hits -----

_CTX = f"""{SEGS}, ch AS (SELECT video_id, ord, start_ms, end_ms, greatest(0, start_ms - 500) AS i_s, end_ms + 500 AS i_e FROM segs),
hit AS (SELECT video_id, start_ms, end_ms FROM segs WHERE role = 'system'), {merged('hit', 'req')},
sel AS (SELECT c.video_id, c.ord FROM ch c WHERE EXISTS (
  SELECT 1 FROM req r WHERE r.video_id = c.video_id AND c.start_ms < r.end_ms AND r.start_ms < c.end_ms)),
ctx AS (SELECT DISTINCT c.* FROM ch c JOIN sel s ON s.video_id = c.video_id AND abs(c.ord - s.ord) <= 1)"""


def _turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = conversation_segments(spark, sf_dir)
    return segments.select(
        "video_id",
        "ord",
        F.col("segment_id").alias("chunk_id"),
        "source",
        "start_ms",
        "end_ms",
        F.greatest(F.lit(0), F.col("start_ms") - 500).alias("insp_start_ms"),
        (F.col("end_ms") + 500).alias("insp_end_ms"),
    )


def _requested(chunks: DataFrame) -> DataFrame:
    return context.requested_ranges(chunks, hits=chunks.where("source = 'system'"))


@query(f"""WITH {SEGS}, asked AS (SELECT video_id, start_ms, end_ms FROM segs WHERE role = 'system' OR ord % 5 = 4
  UNION ALL SELECT video_id, start_ms + 1000, end_ms + 3000 FROM segs WHERE ord % 4 = 0), {merged('asked', 'm')}
SELECT video_id, start_ms, end_ms FROM m""")
def context_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit ranges, hits and named chunks asked for at once."""
    chunks = _turn_chunks(spark, sf_dir)
    ranges = chunks.where("ord % 4 = 0").selectExpr("video_id", "start_ms + 1000 AS start_ms", "end_ms + 3000 AS end_ms")
    asked = context.requested_ranges(chunks, ranges, chunks.where("source = 'system'"), chunks.where("ord % 5 = 4"))
    return asked.select("video_id", "start_ms", "end_ms")


@query(f"""WITH {SEGS} SELECT video_id, segment_id, 5000 * (video_id % 3) AS source_start_ms FROM segs
WHERE start_ms < 5000 * (video_id % 3) + 12000 AND 5000 * (video_id % 3) < end_ms""")
def segments_in_source_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments outside their video's source range are dropped; those across its ends stay whole."""
    segments = conversation_segments(spark, sf_dir)
    start = 5_000 * (F.col("video_id") % 3)
    sources = segments.select("video_id").distinct().withColumns({"source_start_ms": start, "source_end_ms": start + 12_000})
    return chunking.in_source_range(segments, sources).select("video_id", "segment_id", "source_start_ms")


@query(f"WITH {_CTX} SELECT video_id, ord, start_ms, end_ms FROM ctx")
def context_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turn_chunks(spark, sf_dir)
    picked = context.context_chunks(chunks, _requested(chunks), adjacent_chunks=1)
    return picked.select("video_id", "ord", "start_ms", "end_ms")


@query(f"""WITH {_CTX}, ob AS (SELECT video_id, i_s AS start_ms, i_e AS end_ms FROM ctx), {merged('ob', 'res')}
SELECT video_id, start_ms, end_ms FROM res""")
def context_resolved_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turn_chunks(spark, sf_dir)
    parts = context.timeline_context(chunks, chunks, chunks, _requested(chunks), adjacent_chunks=1)
    return parts["resolved"].select("video_id", "start_ms", "end_ms")


@query(f"""WITH {_CTX}, ob AS (SELECT video_id, i_s AS start_ms, i_e AS end_ms FROM ctx), {merged('ob', 'res')}, {grid_shots('segs')}
SELECT s.video_id, s.shot_id, s.start_ms, s.end_ms FROM shots s WHERE EXISTS (
  SELECT 1 FROM res r WHERE r.video_id = s.video_id AND s.start_ms < r.end_ms AND r.start_ms < s.end_ms)""")
def context_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turn_chunks(spark, sf_dir)
    parts = context.timeline_context(chunks, make_shots(chunks), chunks, _requested(chunks), adjacent_chunks=1)
    return parts["shots"].select("video_id", "shot_id", "start_ms", "end_ms")


@query(f"""WITH RECURSIVE {SEGS}, ch AS (SELECT video_id, ord, role, end_ms + 500 - greatest(0, start_ms - 500) AS d FROM segs),
an AS (SELECT video_id, ord FROM ch WHERE role = 'system' OR ord = 3),
base AS (SELECT video_id, CAST(sum(d) AS BIGINT) AS used FROM ch JOIN an USING (video_id, ord) GROUP BY video_id),
cand AS (SELECT c.video_id, c.ord, c.d, min(abs(c.ord - a.ord)) AS dist FROM ch c JOIN an a ON a.video_id = c.video_id
         AND abs(c.ord - a.ord) <= 3 GROUP BY c.video_id, c.ord, c.d HAVING min(abs(c.ord - a.ord)) > 0),
num AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY dist, ord) AS k FROM cand),
walk AS (
  SELECT video_id, CAST(0 AS BIGINT) AS k, used, CAST(-1 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS dist, false AS ok FROM base
  UNION ALL
  SELECT n.video_id, n.k, CASE WHEN w.used + n.d <= 20000 THEN w.used + n.d ELSE w.used END, n.ord, n.dist, w.used + n.d <= 20000
  FROM walk w JOIN num n ON n.video_id = w.video_id AND n.k = w.k + 1)
SELECT video_id, ord, dist AS distance, ok AS admitted FROM walk WHERE k > 0
UNION ALL SELECT video_id, ord, 0, true FROM an""")
def context_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _turn_chunks(spark, sf_dir)
    anchors = chunks.where("source = 'system' OR ord = 3").select("video_id", "ord")
    placed = context.budgeted_context(
        chunks, anchors, context.Direction.BOTH, adjacent_chunks=3, max_duration_ms=20_000
    )
    return placed.select("video_id", "ord", F.col("distance").cast("bigint").alias("distance"), "admitted")


@query(f"""WITH {SEGS}, {grid_shots('segs')}
SELECT s.video_id, s.segment_id AS frame_id, string_agg(h.shot_id, ',' ORDER BY h.ord) AS shot_ids
FROM segs s JOIN shots h ON h.video_id = s.video_id AND h.start_ms <= s.start_ms AND s.start_ms < h.end_ms
GROUP BY s.video_id, s.segment_id""")
def frame_shot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = conversation_segments(spark, sf_dir)
    stills = segments.select("video_id", F.col("segment_id").alias("frame_id"), F.col("start_ms").alias("timestamp_ms"))
    linked = frames.frame_shots(stills, make_shots(segments))
    return linked.select("video_id", "frame_id", F.array_join("segment_ids", ",").alias("shot_ids"))


@query(f"""WITH {SEGS}, t AS (SELECT video_id, ord AS target_no, start_ms + 3000 AS start_ms, end_ms + 2500 AS end_ms FROM segs WHERE role = 'user')
SELECT t.video_id, t.target_no, string_agg(s.segment_id, ',' ORDER BY s.start_ms) AS frame_ids
FROM t JOIN segs s ON s.video_id = t.video_id AND t.start_ms <= s.start_ms AND s.start_ms < t.end_ms
GROUP BY t.video_id, t.target_no""")
def target_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = conversation_segments(spark, sf_dir)
    targets = segments.where("source = 'user'").select(
        "video_id", F.col("ord").alias("target_id"), (F.col("start_ms") + 3_000).alias("start_ms"), (F.col("end_ms") + 2_500).alias("end_ms")
    )
    stills = segments.select("video_id", F.col("segment_id").alias("frame_id"), F.col("start_ms").alias("timestamp_ms"))
    linked = frames.target_frames(targets, stills)
    return linked.select("video_id", F.col("target_id").alias("target_no"), F.array_join("frame_ids", ",").alias("frame_ids"))


@query(f"""WITH {SEGS}, {grid_shots('segs')}, cov AS (SELECT video_id, start_ms, end_ms FROM segs WHERE role = 'assistant'),
t AS (SELECT video_id, max(end_ms) AS hi FROM segs GROUP BY video_id), {merged('cov', 'm')},
gap AS (
  SELECT t.video_id, coalesce(lag(m.end_ms) OVER (PARTITION BY t.video_id ORDER BY m.start_ms), 0) AS g_s, coalesce(m.start_ms, hi) AS g_e
  FROM t LEFT JOIN m USING (video_id)
  UNION ALL SELECT t.video_id, max(m.end_ms), max(hi) FROM t JOIN m USING (video_id) GROUP BY t.video_id),
av AS (SELECT s.* FROM shots s WHERE EXISTS (SELECT 1 FROM gap WHERE gap.video_id = s.video_id AND g_s < g_e AND s.start_ms < g_e AND g_s < s.end_ms)),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS k FROM av),
w AS (SELECT DISTINCT video_id, CAST(round_even(i * (k - 1) / 3::DOUBLE, 0) AS BIGINT) AS pos FROM (SELECT DISTINCT video_id, k, unnest(range(4)) AS i FROM n WHERE k > 4))
SELECT n.video_id, n.shot_id FROM n LEFT JOIN w USING (video_id, pos) WHERE k <= 4 OR w.pos IS NOT NULL""")
def timeline_scan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four evenly spread shots out of those touching unseen parts of each timeline."""
    from tidemark.plans.overlap import overlap_semi

    segments = conversation_segments(spark, sf_dir)
    totals = segments.groupBy("video_id").agg(
        F.lit(0).cast("bigint").alias("total_start_ms"), F.max("end_ms").alias("total_end_ms")
    )
    unseen = ranges.unseen_ranges(segments.where("source = 'assistant'"), totals)
    available = overlap_semi(make_shots(segments), unseen)
    return frames.even_selection(available, 4).select("video_id", "shot_id")
