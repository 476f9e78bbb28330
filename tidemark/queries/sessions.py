"""Session ledgers over the event stream table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.plans.ordered import numbered, ordered
from tidemark.queries import query
from tidemark.queries.sql import IV, merged
from tidemark.session import read_table
from tidemark.sources.workload import event_intervals

# A user is a run, a day is a call, an event is a hit ranked by value, and the
# props payload is the candidate it returns.
_HITS = """hits AS (
  SELECT user_id AS run_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS call_no, event_id, props AS candidate_id,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, event_id) AS rank
  FROM events)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    events = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), day.alias("call_no"), "event_id", (-F.col("value")).alias("falling"), F.col("props").alias("candidate_id")
    )
    ranked = numbered(ordered(events, ["run_id", "call_no"], ["falling", "event_id"]), "rank").done()
    return ranked.withColumn("rank", F.col("rank") + 1).drop("falling")


@query(f"""WITH {_HITS}, m AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, candidate_id ORDER BY call_no, rank) = 1 AS fresh FROM hits),
n AS (SELECT *, fresh AND sum(CAST(fresh AS INT)) OVER (PARTITION BY run_id, call_no ORDER BY rank) <= 2 AS is_new FROM m),
r AS (SELECT *, sum(CASE WHEN is_new THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, call_no ORDER BY rank) AS rest FROM n)
SELECT run_id, call_no, rank, candidate_id, CASE WHEN is_new THEN 'new' ELSE 'reused' END AS status FROM r WHERE is_new OR rest <= 2""")
def new_vs_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.split_new_and_reused(_hits(spark, sf_dir), top_k=2)


@query("""WITH c AS (
  SELECT user_id AS run_id, event_id, ts, event_type = 'purchase' AS gained,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
g AS (SELECT *, coalesce(max(CASE WHEN gained THEN pos END) OVER (PARTITION BY run_id ORDER BY pos), 0) AS gain_at FROM c)
SELECT run_id, event_id, pos - gain_at AS streak, pos - gain_at >= 2 AS replan FROM g""")
def no_gain_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "event_id", "ts", (F.col("event_type") == "purchase").alias("gained")
    )
    return ledger.no_gain_streaks(calls, order=("ts", "event_id")).select("run_id", "event_id", "streak", "replan")


@query("""WITH c AS (
  SELECT user_id AS run_id, event_id, CAST(floor(value * 100) AS BIGINT) AS tokens,
         CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent
  FROM events)
SELECT run_id, event_id, spent, t.threshold FROM c, (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) t(threshold)
WHERE spent / 300000.0::DOUBLE >= t.threshold AND (spent - tokens) / 300000.0::DOUBLE < t.threshold""")
def budget_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "event_id", "ts", F.floor(F.col("value") * 100).cast("bigint").alias("tokens")
    )
    warned = ledger.budget_warnings(calls, 300_000, order=("ts", "event_id"))
    return warned.select("run_id", "event_id", "spent", "threshold")


@query("""SELECT user_id AS run_id, count(*) AS calls, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS wall_time_ms,
  CAST(sum(length(props)) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS model_calls,
  CAST(sum(event_id % 7) AS BIGINT) AS input_items, CAST(sum(event_id % 11 * 40) AS BIGINT) AS processed_duration_ms,
  CAST(sum(event_id % 13) AS BIGINT) AS decoded_frames, CAST(sum(CASE WHEN event_type = 'view' THEN event_id % 13 ELSE 0 END) AS BIGINT) AS returned_frames,
  CAST(sum(length(event_type)) AS BIGINT) AS output_tokens
FROM events GROUP BY user_id""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.floor(F.col("value") * 1_000).cast("bigint").alias("wall_time_ms"),
        F.length("props").cast("bigint").alias("input_tokens"),
        (F.col("event_type") == "click").cast("bigint").alias("model_calls"),
        F.lit(1).cast("bigint").alias("output_items"),
        (F.col("event_id") % 7).alias("input_items"),
        (F.col("event_id") % 11 * 40).alias("processed_duration_ms"),
        (F.col("event_id") % 13).alias("decoded_frames"),
        F.when(F.col("event_type") == "view", F.col("event_id") % 13).otherwise(0).alias("returned_frames"),
        F.length("event_type").cast("bigint").alias("output_tokens"),
    )
    return ledger.usage_rollup(usage, ["run_id"]).withColumnRenamed("output_items", "calls")


@query("""SELECT run_id, event_id FROM (
  SELECT user_id AS run_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 6""")
def latest_tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts")
    return ledger.latest(events, 6, ["run_id"], ["ts", "event_id"]).select("run_id", "event_id")


@query("""WITH e AS (SELECT user_id AS run_id, props AS evidence_id, event_id, value FROM events)
SELECT run_id, evidence_id, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value, min(event_id) AS first_event
FROM e GROUP BY run_id, evidence_id""")
def evidence_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct evidence per run: the last version of an id stays."""
    items = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("props").alias("evidence_id"), "event_id", "value"
    )
    kept = ledger.latest_by_id(items, ["run_id", "evidence_id"], ["event_id"])
    return kept.select("run_id", "evidence_id", "event_id", "value", F.col("first_seen.event_id").alias("first_event"))


@query(f"""WITH {IV}, b AS (SELECT video_id AS run_id, start_ms, end_ms FROM iv WHERE event_type <> 'error'), {merged('b', 'm', keys='run_id')}
SELECT run_id, start_ms, end_ms FROM m""")
def evidence_bundle_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = event_intervals(spark, sf_dir).where("event_type <> 'error'").withColumnRenamed("video_id", "run_id")
    return ledger.evidence_bundle_ranges(evidence).select("run_id", "start_ms", "end_ms")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS video_id, o_orderkey AS manifest_no, l_suppkey AS frame_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w AS (SELECT o_orderkey AS request_id, o_custkey AS video_id, l_suppkey AS frame_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2),
d AS (SELECT DISTINCT * FROM w), n AS (SELECT request_id, count(*) AS n FROM d GROUP BY request_id)
SELECT request_id, video_id, max(manifest_no) AS manifest_no FROM (
  SELECT d.request_id, d.video_id, f.manifest_no, count(*) AS k FROM d JOIN f USING (video_id, frame_id) GROUP BY ALL)
JOIN n USING (request_id) WHERE k = n GROUP BY request_id, video_id""")
def covering_frame_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a frame manifest of its customer, its suppliers are the frames."""
    lines = (
        read_table(spark, sf_dir, "lineitem")
        .join(read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("video_id"),
            F.col("o_orderkey").alias("manifest_no"),
            F.col("l_suppkey").alias("frame_id"),
            "l_linenumber",
        )
    )
    wanted = lines.where("l_linenumber <= 2").withColumnRenamed("manifest_no", "request_id")
    return ledger.covering_manifests(lines, wanted)


@query(f"""WITH {IV}, p AS (
  SELECT video_id, 'purchase_' || event_id AS target_id, start_ms, end_ms, 0 AS pr FROM iv WHERE event_type = 'purchase'
  UNION ALL SELECT video_id, 'view_' || event_id, start_ms // 3600000 * 3600000, start_ms // 3600000 * 3600000 + 3600000, 1 FROM iv WHERE event_type = 'view'
  UNION ALL SELECT video_id, 'click_' || event_id, start_ms // 3600000 * 3600000, start_ms // 3600000 * 3600000 + 3600000, 2 FROM iv WHERE event_type = 'click')
SELECT video_id, min_by(target_id, (pr, target_id)) AS target_id, start_ms, end_ms FROM p GROUP BY video_id, start_ms, end_ms""")
def target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three target lists; for an equal range the list named first wins."""
    iv = event_intervals(spark, sf_dir)
    hour = F.floor(F.col("start_ms") / 3_600_000).cast("bigint") * 3_600_000

    def part(kind: str, start, end) -> DataFrame:
        return iv.where(F.col("event_type") == kind).select(
            "video_id",
            F.concat(F.lit(kind + "_"), F.col("event_id")).alias("target_id"),
            start.alias("start_ms"),
            end.alias("end_ms"),
            F.lit(None).cast("string").alias("chunk_id"),
            F.lit(0).alias("pos"),
        )

    parts = [
        part("purchase", F.col("start_ms"), F.col("end_ms")),
        part("view", hour, hour + 3_600_000),
        part("click", hour, hour + 3_600_000),
    ]
    return ledger.resolve_targets(parts).drop("chunk_id")
