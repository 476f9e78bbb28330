"""Interval algebra, joins, clips and frame sampling on event timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.intervals import contains_range, duration_ms, intersection, map_timeline, overlaps
from tidemark.operators import clips, frames, ranges
from tidemark.plans.ordered import ordered, running
from tidemark.plans.overlap import overlap_join, overlap_semi, point_in_interval_join
from tidemark.plans.ranks import rank_ranges
from tidemark.queries import query
from tidemark.queries.sql import IV, merged
from tidemark.session import read_table
from tidemark.sources.workload import event_intervals


def _typed(iv: DataFrame, kind: str) -> DataFrame:
    return iv.where(F.col("event_type") == kind)


def _islands(iv: DataFrame, kind: str) -> DataFrame:
    """Merged ranges of one event type: disjoint, like the chunks or shots of a video."""
    return ranges.merge_ranges(_typed(iv, kind)).drop("n_ranges")


def _hull(iv: DataFrame) -> DataFrame:
    return iv.groupBy("video_id").agg(
        (F.min("start_ms") - 1_000).alias("total_start_ms"), (F.max("end_ms") + 1_000).alias("total_end_ms")
    )


@query(f"WITH {IV}, {merged('iv', 'm')} SELECT video_id, start_ms, end_ms, n_ranges FROM m")
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.merge_ranges(event_intervals(spark, sf_dir))


@query(f"""WITH {IV}, {merged('iv', 'm')},
hull AS (SELECT video_id, min(start_ms) - 1000 AS lo, max(end_ms) + 1000 AS hi FROM iv GROUP BY video_id),
g AS (SELECT m.video_id, coalesce(lag(end_ms) OVER (PARTITION BY m.video_id ORDER BY start_ms), lo) AS start_ms, start_ms AS end_ms
      FROM m JOIN hull USING (video_id)
      UNION ALL
      SELECT m.video_id, max(end_ms), max(hi) FROM m JOIN hull USING (video_id) GROUP BY m.video_id)
SELECT video_id, start_ms, end_ms FROM g WHERE start_ms < end_ms""")
def range_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    return ranges.unseen_ranges(iv, _hull(iv))


_SUBTRACT = f"""{IV}, known AS (SELECT video_id, start_ms, end_ms FROM iv WHERE event_type = 'view'), {merged('known', 'k')},
items AS (SELECT video_id, event_id, start_ms, end_ms FROM iv WHERE event_type = 'purchase'),
hits AS (
  SELECT i.video_id, i.event_id, i.start_ms AS i_s, i.end_ms AS i_e, k.start_ms AS k_s, k.end_ms AS k_e,
         lag(k.end_ms) OVER (PARTITION BY i.event_id ORDER BY k.start_ms) AS before_e
  FROM items i JOIN k ON k.video_id = i.video_id AND k.start_ms < i.end_ms AND i.start_ms < k.end_ms),
pieces AS (
  SELECT video_id, event_id, coalesce(before_e, i_s) AS start_ms, k_s AS end_ms FROM hits
  UNION ALL
  SELECT video_id, event_id, max(k_e), max(i_e) FROM hits GROUP BY video_id, event_id
  UNION ALL
  SELECT video_id, event_id, start_ms, end_ms FROM items WHERE event_id NOT IN (SELECT event_id FROM hits)),
rest AS (SELECT * FROM pieces WHERE start_ms < end_ms)"""


@query(f"WITH {_SUBTRACT} SELECT video_id, event_id, start_ms, end_ms FROM rest")
def range_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    items = _typed(iv, "purchase").select("video_id", "event_id", "start_ms", "end_ms")
    return ranges.subtract_ranges(items, _typed(iv, "view"))


@query(f"WITH {_SUBTRACT}, {merged('rest', 'n')} SELECT video_id, start_ms, end_ms FROM n")
def newly_covered_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    items = _typed(iv, "purchase").select("video_id", "start_ms", "end_ms")
    return ranges.newly_covered(items, _typed(iv, "view")).select("video_id", "start_ms", "end_ms")


@query(f"""WITH {IV}, v AS (SELECT * FROM iv WHERE event_type = 'view'), {merged('v', 'm')},
d AS (SELECT video_id, max(end_ms) - min(start_ms) AS duration_ms FROM iv GROUP BY video_id),
c AS (SELECT video_id, sum(end_ms - start_ms) AS covered_ms FROM m GROUP BY video_id)
SELECT d.video_id, CAST(coalesce(covered_ms, 0) AS BIGINT) AS covered_ms,
       round(least(1.0, coalesce(covered_ms, 0) / d.duration_ms), 9) AS coverage
FROM d LEFT JOIN c USING (video_id)""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    totals = iv.groupBy("video_id").agg((F.max("end_ms") - F.min("start_ms")).alias("duration_ms"))
    covered = ranges.coverage_ratio(_typed(iv, "view"), totals)
    return covered.select(
        "video_id", "covered_ms", F.round(F.coalesce("coverage", F.lit(0.0)), 9).alias("coverage")
    )


_PURCHASES = f"""{IV}, pu AS (SELECT * FROM iv WHERE event_type = 'purchase'), {merged('pu', 'k')}"""
_VIEWS = f"""{IV}, vi AS (SELECT * FROM iv WHERE event_type = 'view'), {merged('vi', 'k')}"""


@query(f"""WITH {_PURCHASES}
SELECT i.video_id, i.event_id, string_agg(CAST(k.start_ms AS VARCHAR), ',' ORDER BY k.start_ms) AS chunk_ids, count(*) AS n_chunks
FROM iv i JOIN k ON k.video_id = i.video_id AND i.start_ms < k.end_ms AND k.start_ms < i.end_ms
WHERE i.event_type <> 'purchase' GROUP BY i.video_id, i.event_id""")
def overlap_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.indexing import overlapping_ids

    iv = event_intervals(spark, sf_dir)
    items = iv.where("event_type <> 'purchase'").withColumnRenamed("event_id", "item_id")
    spans = _islands(iv, "purchase").select(
        "video_id", F.col("start_ms").cast("string").alias("chunk_id"), F.col("start_ms").alias("ord"), "start_ms", "end_ms"
    )
    linked = overlapping_ids(items, spans, "chunk_id", "ids", disjoint=True)
    return linked.select(
        "video_id",
        F.col("item_id").alias("event_id"),
        F.array_join("ids", ",").alias("chunk_ids"),
        F.size("ids").cast("bigint").alias("n_chunks"),
    )


@query(f"""WITH {_PURCHASES}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) - 1 AS place FROM k)
SELECT i.video_id, i.event_id, min(place) AS first_rank, max(place) AS last_rank, count(place) AS n_spans
FROM iv i LEFT JOIN n ON n.video_id = i.video_id AND i.start_ms < n.end_ms AND n.start_ms < i.end_ms
WHERE i.event_type <> 'purchase' GROUP BY i.video_id, i.event_id""")
def overlap_rank_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which merged purchase intervals every other event meets, as a run of their positions."""
    iv = event_intervals(spark, sf_dir)
    spans = _islands(iv, "purchase").select("video_id", "start_ms", "end_ms")
    return rank_ranges(iv.where("event_type <> 'purchase'"), spans, ["event_id"])


@query(f"""WITH {_VIEWS}
SELECT i.video_id, i.event_id, greatest(i.start_ms, k.start_ms) AS start_ms, least(i.end_ms, k.end_ms) AS end_ms
FROM iv i JOIN k ON k.video_id = i.video_id AND i.start_ms < k.end_ms AND k.start_ms < i.end_ms
WHERE i.event_type = 'click'""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each click interval that lie in viewed time."""
    iv = event_intervals(spark, sf_dir)
    right = _islands(iv, "view").select(
        "video_id", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms")
    )
    pairs = overlap_join(_typed(iv, "click").select("video_id", "event_id", "start_ms", "end_ms"), right)
    shared = intersection("start_ms", "end_ms", "r_start_ms", "r_end_ms")
    return pairs.withColumn("_x", shared).select(
        "video_id", "event_id", F.col("_x.start_ms").alias("start_ms"), F.col("_x.end_ms").alias("end_ms")
    )


@query(f"""WITH {IV}
SELECT video_id, event_id, start_ms, end_ms FROM iv i
WHERE event_type <> 'error' AND EXISTS (
  SELECT 1 FROM iv k WHERE k.event_type = 'error' AND k.video_id = i.video_id
   AND i.start_ms < k.end_ms AND k.start_ms < i.end_ms)""")
def overlap_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir).select("video_id", "event_id", "event_type", "start_ms", "end_ms")
    left = iv.where("event_type <> 'error'").drop("event_type")
    return overlap_semi(left, _typed(iv, "error"))


@query(f"""WITH {_PURCHASES}
SELECT i.video_id, i.event_id, i.start_ms AS timestamp_ms, k.start_ms AS holder_start_ms
FROM iv i JOIN k ON k.video_id = i.video_id AND k.start_ms <= i.start_ms AND i.start_ms < k.end_ms
WHERE i.event_type = 'click'""")
def point_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    points = _typed(iv, "click").select("video_id", "event_id", F.col("start_ms").alias("timestamp_ms"))
    holders = _islands(iv, "purchase").select("video_id", F.col("start_ms").alias("holder_start_ms"), "end_ms")
    return point_in_interval_join(
        points, holders, ["video_id"], "timestamp_ms", "holder_start_ms", "end_ms"
    ).drop("end_ms")


@query(f"""WITH {IV}, p AS (
  SELECT *, lag(start_ms) OVER w AS p_start, lag(end_ms) OVER w AS p_end FROM iv
  WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, end_ms, event_id))
SELECT video_id, event_id, end_ms - start_ms AS duration_ms,
       p_start < end_ms AND start_ms < p_end AS overlaps_previous,
       p_start <= start_ms AND end_ms <= p_end AS inside_previous,
       CASE WHEN greatest(start_ms, p_start) < least(end_ms, p_end) THEN greatest(start_ms, p_start) ELSE -1 END AS shared_start_ms,
       CASE WHEN greatest(start_ms, p_start) < least(end_ms, p_end) THEN least(end_ms, p_end) ELSE -1 END AS shared_end_ms,
       greatest(0, start_ms - p_end) AS silence_ms
FROM p WHERE p_start IS NOT NULL""")
def interval_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir).select("video_id", "event_id", "start_ms", "end_ms")
    scan = running(
        ordered(iv, ["video_id"], ["start_ms", "end_ms", "event_id"]),
        {"p_start": ("last", F.col("start_ms")), "p_end": ("last", F.col("end_ms"))},
        inclusive=False,
    )
    shared = intersection("start_ms", "end_ms", "p_start", "p_end")
    return scan.done().where(F.col("p_start").isNotNull()).withColumn("_x", shared).select(
        "video_id",
        "event_id",
        duration_ms("start_ms", "end_ms").alias("duration_ms"),
        overlaps("p_start", "p_end", "start_ms", "end_ms").alias("overlaps_previous"),
        contains_range("p_start", "p_end", "start_ms", "end_ms").alias("inside_previous"),
        F.coalesce("_x.start_ms", F.lit(-1)).alias("shared_start_ms"),
        F.coalesce("_x.end_ms", F.lit(-1)).alias("shared_end_ms"),
        F.greatest(F.lit(0), F.col("start_ms") - F.col("p_end")).alias("silence_ms"),
    )


@query(f"""WITH {IV}, h AS (SELECT video_id, min(start_ms) AS lo, max(start_ms) AS hi FROM iv GROUP BY video_id)
SELECT video_id, event_id, CASE WHEN lo <= start_ms AND start_ms < hi THEN start_ms - lo ELSE -1 END AS clip_ms
FROM iv JOIN h USING (video_id)""")
def timeline_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    hull = iv.groupBy("video_id").agg(F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"))
    return iv.join(hull, "video_id").select(
        "video_id", "event_id", F.coalesce(map_timeline("start_ms", "lo", "hi", F.lit(0)), F.lit(-1)).alias("clip_ms")
    )


@query(f"""WITH {IV}, p AS (
  SELECT video_id, start_ms, lag(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, event_id) AS p_end FROM iv)
SELECT video_id, count(*) AS n_items, count(*) FILTER (WHERE start_ms < p_end) AS n_overlapping FROM p GROUP BY video_id""")
def manifest_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring items of a manifest that overlap, per timeline."""
    iv = event_intervals(spark, sf_dir).select("video_id", "event_id", "start_ms", "end_ms")
    scan = running(
        ordered(iv, ["video_id"], ["start_ms", "end_ms", "event_id"]),
        {"p_end": ("last", F.col("end_ms"))},
        inclusive=False,
    )
    return scan.done().groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("start_ms") < F.col("p_end")).alias("n_overlapping")
    )


# ---- clips -----------------------------------------------------------------

_CLIPS = f"""{IV}, h AS (SELECT video_id, max(end_ms) AS duration_ms FROM iv GROUP BY video_id),
sel AS (
  SELECT video_id, event_id, greatest(0, start_ms - 1500) AS start_ms, least(duration_ms, end_ms + 1500) AS end_ms
  FROM iv JOIN h USING (video_id) WHERE event_type IN ('purchase', 'click')), {merged('sel', 'c', gap=3000)}"""


def _selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    durations = iv.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))
    evidence = iv.where(F.col("event_type").isin("purchase", "click")).withColumn("evidence_id", F.col("event_id"))
    return clips.clip_selections(evidence, durations)


@query(f"""WITH {_CLIPS} SELECT video_id, start_ms, end_ms, n_ranges AS n_evidence FROM c""")
def clip_selection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged_clips = clips.merged_clips(clips.clip_members(_selections(spark, sf_dir)))
    return merged_clips.select("video_id", "start_ms", "end_ms", "n_evidence")


@query(f"""WITH {_CLIPS}, a AS (
  SELECT video_id, count(*) AS n_clips, max(end_ms - start_ms) AS longest_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms
  FROM c GROUP BY video_id)
SELECT *, CASE WHEN n_clips > 5 THEN 'At most 5 clips may be exported.'
  WHEN longest_ms > 45000 THEN 'A clip cannot exceed 45000 ms.'
  WHEN total_ms > 120000 THEN 'Total exported duration cannot exceed 120000 ms.' END AS error FROM a""")
def clip_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged_clips = clips.merged_clips(clips.clip_members(_selections(spark, sf_dir)))
    return clips.clip_limit_errors(merged_clips)


# ---- frame timestamps ------------------------------------------------------

@query(f"""WITH {IV}, {merged('iv', 'm')},
a AS (SELECT video_id, start_ms, end_ms - start_ms AS len,
             sum(end_ms - start_ms) OVER (PARTITION BY video_id ORDER BY start_ms) AS upto FROM m),
t AS (SELECT video_id, CAST(sum(len) AS BIGINT) AS total FROM a GROUP BY video_id),
o AS (SELECT video_id, i, least(CAST(round_even((i + 0.5::DOUBLE) * total / 16, 0) AS BIGINT), total - 1) AS off
      FROM (SELECT video_id, total, unnest(range(16)) AS i FROM t))
SELECT o.video_id, o.i, CAST(a.start_ms + o.off - (a.upto - a.len) AS BIGINT) AS timestamp_ms
FROM o JOIN a ON a.video_id = o.video_id AND a.upto - a.len <= o.off AND o.off < a.upto""")
def uniform_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.uniform_timestamps(ranges.merge_ranges(event_intervals(spark, sf_dir)), 16)


@query(f"""WITH {IV}, {merged('iv', 'm')},
n AS (SELECT video_id, start_ms, CAST(ceil((end_ms - start_ms) / 400000) AS BIGINT) AS n FROM m),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY video_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
k AS (SELECT video_id, start_ms, CAST(least(n, 48 - before) AS BIGINT) AS n FROM b WHERE before < 48)
SELECT video_id, start_ms + i * 400000 AS timestamp_ms
FROM (SELECT video_id, start_ms, unnest(range(n)) AS i FROM k)""")
def fixed_fps_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per 400 s of the merged ranges, at most 48 per timeline."""
    return frames.fixed_rate_timestamps(
        ranges.merge_ranges(event_intervals(spark, sf_dir)), fps=0.0025, max_frames=48
    )


@query(f"""WITH {_VIEWS}, pu AS (SELECT * FROM iv WHERE event_type = 'purchase'), {merged('pu', 'm')},
p AS (SELECT DISTINCT m.video_id, (greatest(m.start_ms, s.start_ms) + least(m.end_ms, s.end_ms)) // 2 AS timestamp_ms
      FROM m JOIN k s ON s.video_id = m.video_id AND s.start_ms < m.end_ms AND m.start_ms < s.end_ms)
SELECT video_id, timestamp_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_ms) AS n FROM p) WHERE n <= 24""")
def keyframe_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    return frames.keyframe_timestamps(_islands(iv, "purchase"), _islands(iv, "view"), max_frames=24)


@query(f"""WITH {IV}, o AS (
  SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY video_id) AS m FROM iv),
w AS (SELECT DISTINCT video_id, CAST(round_even(i * (m - 1) / 7::DOUBLE, 0) AS BIGINT) AS pos
      FROM (SELECT DISTINCT video_id, m, unnest(range(8)) AS i FROM o WHERE m > 8))
SELECT o.video_id, o.event_id FROM o LEFT JOIN w USING (video_id, pos) WHERE o.m <= 8 OR w.pos IS NOT NULL""")
def even_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir).select("video_id", "event_id", "start_ms", "end_ms")
    return frames.even_selection(iv, 8, ("start_ms", "end_ms", "event_id")).select("video_id", "event_id")


@query(f"""WITH {IV}, n AS (SELECT video_id, count(*) AS n_targets FROM iv GROUP BY video_id)
SELECT video_id, d.detail, n_targets,
  CASE d.detail WHEN 'coarse' THEN least(16, greatest(4, n_targets * 2))
                WHEN 'detailed' THEN least(48, greatest(12, n_targets * 8))
                ELSE least(24, greatest(8, n_targets * 4)) END AS max_frames,
  CASE WHEN d.detail = 'detailed' THEN 'dense_window' ELSE 'shot_keyframe' END AS strategy
FROM n, (VALUES ('coarse'), ('standard'), ('detailed')) d(detail)""")
def sampling_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = event_intervals(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("n_targets"))
    details = F.explode(F.array(F.lit("coarse"), F.lit("standard"), F.lit("detailed")))
    return frames.sampling_plans(counts.withColumn("detail", details)).select(
        "video_id", "detail", "n_targets", "max_frames", "strategy"
    )


@query("""WITH RECURSIVE v AS (
  SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
f AS (
  SELECT label, rn, vec_id, e AS kept, true AS is_kept FROM v WHERE rn = 1
  UNION ALL
  SELECT label, rn, vec_id, CASE WHEN d < 0.145 THEN kept ELSE e END, d >= 0.145
  FROM (SELECT v.label, v.rn, v.vec_id, v.e, f.kept,
               list_sum(list_transform(list_zip(v.e, f.kept), lambda p: abs(p[1] - p[2]))) / len(v.e) AS d
        FROM f JOIN v ON v.label = f.label AND v.rn = f.rn + 1))
SELECT label, vec_id FROM f WHERE is_kept""")
def frame_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop vectors that differ little from the last kept vector of their label."""
    vectors = read_table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("video_id"),
        F.col("vec_id").alias("frame_id"),
        F.col("vec_id").alias("timestamp_ms"),
        F.col("embedding").alias("signature"),
    )
    kept = frames.distinct_frames(vectors, threshold=0.145)
    return kept.select(F.col("video_id").alias("label"), F.col("frame_id").alias("vec_id"))
