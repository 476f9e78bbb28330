"""Candidate fusion, claim verification, answer gate and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fusion, verification
from tidemark.plans.ordered import numbered, ordered
from tidemark.queries import query
from tidemark.queries.sql import IV
from tidemark.session import read_table
from tidemark.sources.workload import event_intervals

FUSION = fusion.FusionParams(
    max_gap_ms=10_800_000, max_window_ms=86_400_000, modality_weights={"ocr": 2.0, "visual_description": 0.5}
)

_FUSED = f"""{IV}, hits AS (
  SELECT video_id, modality, event_type || '_' || CAST(floor(value / 10) AS BIGINT) AS source_id, event_id, start_ms, end_ms,
         CASE modality WHEN 'ocr' THEN 1 WHEN 'transcript' THEN 2 ELSE 3 END AS list_no,
         row_number() OVER (PARTITION BY video_id, modality ORDER BY value DESC, event_id) AS rank
  FROM iv),
ev AS (
  SELECT video_id, modality, source_id, min_by(start_ms, (list_no, rank)) AS start_ms, min_by(end_ms, (list_no, rank)) AS end_ms,
         min(list_no) AS list_no, min(rank) AS rank,
         sum(CASE modality WHEN 'ocr' THEN 2.0::DOUBLE WHEN 'visual_description' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)) AS score
  FROM hits GROUP BY video_id, modality, source_id)"""

_CLUSTERED = f"""{_FUSED},
ch AS (SELECT DISTINCT video_id, start_ms // 21600000 AS ord, start_ms // 21600000 * 21600000 AS c_s, start_ms // 21600000 * 21600000 + 21600000 AS c_e FROM iv),
lists AS (SELECT e.video_id, e.modality, e.source_id, list(struct_pack(s := c_s, e := c_e)) AS chs
  FROM ev e JOIN ch ON ch.video_id = e.video_id AND c_s < e.end_ms AND e.start_ms < c_e GROUP BY e.video_id, e.modality, e.source_id),
o AS (SELECT e.*, coalesce(chs, []) AS chs, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, -score, list_no, rank, modality, source_id) AS rn
  FROM ev e LEFT JOIN lists USING (video_id, modality, source_id)),
w AS (
  SELECT video_id, rn, modality, source_id, start_ms AS lo, end_ms AS hi, CAST(0 AS BIGINT) AS cl FROM o WHERE rn = 1
  UNION ALL
  SELECT video_id, rn, modality, source_id,
         CASE WHEN stay THEN lo ELSE start_ms END, CASE WHEN stay THEN greatest(hi, end_ms) ELSE end_ms END, CASE WHEN stay THEN cl ELSE cl + 1 END
  FROM (
    SELECT o.*, w.lo, w.hi, w.cl,
           (o.start_ms <= w.hi + 10800000 OR len(list_filter(o.chs, lambda c: c.s < w.hi AND w.lo < c.e)) > 0)
           AND greatest(w.hi, o.end_ms) - w.lo <= 86400000 AS stay
    FROM w JOIN o ON o.video_id = w.video_id AND o.rn = w.rn + 1)),
members AS (SELECT w.video_id, w.cl, o.* EXCLUDE (video_id) FROM w JOIN o USING (video_id, rn)),
cl AS (SELECT video_id, cl, sum(score) AS rrf, min(start_ms) AS lo, max(end_ms) AS hi, string_agg(DISTINCT modality, ',' ORDER BY modality) AS modalities,
         string_agg(modality || ':' || source_id, ',' ORDER BY rn) AS keys FROM members GROUP BY video_id, cl),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(rrf, 12) DESC, lo, hi) AS rank FROM cl) WHERE rank <= 8),
hull AS (SELECT t.video_id, t.rank, min(c_s) AS a_s, max(c_e) AS a_e FROM top t JOIN ch ON ch.video_id = t.video_id AND c_s < t.hi AND t.lo < c_e GROUP BY t.video_id, t.rank),
al AS (SELECT t.*, CASE WHEN a_e - a_s <= 86400000 THEN a_s ELSE lo END AS start_ms, CASE WHEN a_e - a_s <= 86400000 THEN a_e ELSE hi END AS end_ms
  FROM top t LEFT JOIN hull USING (video_id, rank)),
ids AS (SELECT a.video_id, a.rank, string_agg(CAST(ch.ord AS VARCHAR), ',' ORDER BY c_s) AS chunk_ids FROM al a JOIN ch ON ch.video_id = a.video_id AND c_s < a.end_ms AND a.start_ms < c_e GROUP BY a.video_id, a.rank)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.when(F.col("modality") == "ocr", 1).when(F.col("modality") == "transcript", 2).otherwise(3)
    source = F.concat("event_type", F.lit("_"), F.floor(F.col("value") / 10).cast("bigint"))
    falling = event_intervals(spark, sf_dir).withColumn("falling", -F.col("value"))
    ranked = numbered(ordered(falling, ["video_id", "modality"], ["falling", "event_id"]), "rank").done()
    return ranked.select(
        "video_id",
        "modality",
        lists.alias("list_no"),
        (F.col("rank") + 1).alias("rank"),
        F.array(source).alias("source_ids"),
        "start_ms",
        "end_ms",
        F.col("event_type").alias("text"),
    )


def _quarter_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = 21_600_000
    cell = F.floor(F.col("start_ms") / size).cast("bigint")
    return (
        event_intervals(spark, sf_dir)
        .select("video_id", cell.alias("ord"))
        .distinct()
        .select(
            "video_id",
            "ord",
            F.col("ord").cast("string").alias("chunk_id"),
            F.col("ord").cast("string").alias("shot_id"),
            (F.col("ord") * size).alias("start_ms"),
            (F.col("ord") * size + size).alias("end_ms"),
        )
    )


@query(f"WITH {_FUSED} SELECT video_id, modality, source_id, start_ms, end_ms, round(score, 9) AS score FROM ev")
def fused_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse_evidence(_hits(spark, sf_dir), FUSION)
    return fused.select("video_id", "modality", "source_id", "start_ms", "end_ms", F.round("score", 9).alias("score"))


@query(f"""WITH RECURSIVE {_CLUSTERED}
SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_items, round(sum(score), 9) AS score FROM members GROUP BY video_id, cl""")
def evidence_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse_evidence(_hits(spark, sf_dir), FUSION)
    clustered = fusion.cluster_evidence(fused, _quarter_days(spark, sf_dir), FUSION)
    return clustered.groupBy("video_id", "cluster_no").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.count(F.lit(1)).alias("n_items"),
        F.round(F.sum("score"), 9).alias("score"),
    ).drop("cluster_no")


@query(f"""WITH RECURSIVE {_CLUSTERED}
SELECT al.video_id, al.rank, al.start_ms, al.end_ms, al.modalities, round(al.rrf, 9) AS fusion_rrf, al.keys AS evidence_keys, ids.chunk_ids, ids.chunk_ids AS shot_ids
FROM al JOIN ids USING (video_id, rank)""")
def candidate_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _quarter_days(spark, sf_dir)
    windows = fusion.candidate_windows(_hits(spark, sf_dir), grid, grid, FUSION)
    return windows.select(
        "video_id",
        F.col("rank").cast("bigint").alias("rank"),
        "start_ms",
        "end_ms",
        F.array_join("modalities", ",").alias("modalities"),
        F.round("fusion_rrf", 9).alias("fusion_rrf"),
        F.array_join("evidence_keys", ",").alias("evidence_keys"),
        F.array_join("chunk_ids", ",").alias("chunk_ids"),
        F.array_join("shot_ids", ",").alias("shot_ids"),
    )


# ---- verification: a labelled document is an answer -------------------------

_ANSWERS = """ans AS (
  SELECT l.doc_id AS answer_id, d.source AS video_id, d.lang, d.n_chars, l.quality, l.toxic,
         CASE WHEN toxic = 1 AND quality = 0 THEN 'global' WHEN toxic = 1 THEN 'screen_text' WHEN quality = 0 THEN 'visual' ELSE 'causal' END AS intent,
         least(1.0, d.n_chars / 5003.0::DOUBLE) AS coverage
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
ev AS (
  SELECT a.answer_id, 'doc_' || d.doc_id AS evidence_id, d.source AS video_id, d.doc_id,
         CASE d.lang WHEN 'fr' THEN 'ocr' WHEN 'de' THEN 'visual_description' WHEN 'es' THEN 'frame' ELSE 'transcript' END AS modality, d.text
  FROM ans a JOIN documents d ON d.doc_id = a.answer_id OR (d.doc_id = a.answer_id + 1 AND d.lang = a.lang)),
cl AS (
  SELECT answer_id, 1 AS claim_no, ['doc_' || answer_id, 'doc_' || (answer_id + 1)] AS ids, quality * 0.5 + 0.25 AS confidence FROM ans
  UNION ALL SELECT answer_id, 2, CAST([] AS VARCHAR[]), NULL FROM ans WHERE toxic = 1),
agg AS (
  SELECT a.answer_id, any_value(a.intent) AS intent, any_value(a.coverage) AS coverage, any_value(a.video_id) AS video_id, any_value(toxic) AS toxic,
         any_value(quality * 0.5 + 0.25) AS confidence, count(e.evidence_id) AS n,
         max(CASE WHEN e.doc_id = a.answer_id + 1 THEN 1 ELSE 0 END) AS has_next,
         max(CASE WHEN e.doc_id = a.answer_id + 1 AND e.video_id <> a.video_id THEN 1 ELSE 0 END) AS wrong_next,
         bool_or(e.modality IN ('frame', 'visual_description', 'vlm_observation')) AS has_visual, bool_or(e.modality = 'ocr') AS has_ocr
  FROM ans a LEFT JOIN ev e USING (answer_id) GROUP BY a.answer_id),
msg AS (
  SELECT *, list_filter([
    CASE WHEN has_next = 0 THEN 'Claim 1 references unknown evidence: doc_' || (answer_id + 1) || '.' END,
    CASE WHEN toxic = 1 THEN 'Claim 2 has no supporting evidence.' END,
    CASE WHEN wrong_next = 1 THEN 'Evidence belongs to another video: doc_' || (answer_id + 1) || '.' END,
    CASE WHEN intent = 'visual' AND NOT has_visual THEN 'The visual question has no visual-model or frame evidence.' END,
    CASE WHEN intent = 'screen_text' AND NOT has_ocr THEN 'The screen-text question has no OCR evidence.' END,
    CASE WHEN intent = 'causal' AND n < 2 THEN 'The causal question lacks corroborating evidence.' END,
    CASE WHEN intent = 'global' AND coverage < 0.7 THEN 'Timeline coverage ' || format('{:.2f}', coverage) || ' is below the required 0.70.' END],
    lambda m: m IS NOT NULL) AS missing FROM agg)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    documents = read_table(spark, sf_dir, "documents").drop("text")
    intent = (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "global")
        .when(F.col("toxic") == 1, "screen_text")
        .when(F.col("quality") == 0, "visual")
        .otherwise("causal")
    )
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("answer_id"),
        F.col("source").alias("video_id"),
        "lang",
        "quality",
        "toxic",
        intent.alias("intent"),
        F.least(F.lit(1.0), F.col("n_chars") / F.lit(5003.0)).alias("coverage"),
    )


def _evidence(spark: SparkSession, sf_dir: str, answers: DataFrame) -> DataFrame:
    wanted = answers.select(
        "answer_id",
        F.col("lang").alias("answer_lang"),
        F.explode(F.array(F.col("answer_id"), F.col("answer_id") + 1)).alias("doc_id"),
    )
    modality = (
        F.when(F.col("lang") == "fr", "ocr")
        .when(F.col("lang") == "de", "visual_description")
        .when(F.col("lang") == "es", "frame")
        .otherwise("transcript")
    )
    documents = read_table(spark, sf_dir, "documents")
    return (
        wanted.join(documents, "doc_id")
        .where((F.col("doc_id") == F.col("answer_id")) | (F.col("lang") == F.col("answer_lang")))
        .select(
            "answer_id",
            F.concat(F.lit("doc_"), F.col("doc_id")).alias("evidence_id"),
            F.col("source").alias("video_id"),
            modality.alias("modality"),
            F.lit(0).cast("bigint").alias("start_ms"),
            F.col("n_chars").alias("end_ms"),
            "text",
        )
    )


def _claims(answers: DataFrame) -> DataFrame:
    one = answers.select(
        "answer_id",
        F.lit(1).alias("claim_no"),
        F.array(
            F.concat(F.lit("doc_"), F.col("answer_id")), F.concat(F.lit("doc_"), F.col("answer_id") + 1)
        ).alias("evidence_ids"),
        (F.col("quality") * 0.5 + 0.25).alias("confidence"),
    )
    two = answers.where("toxic = 1").select(
        "answer_id",
        F.lit(2).alias("claim_no"),
        F.array().cast("array<string>").alias("evidence_ids"),
        F.lit(None).cast("double").alias("confidence"),
    )
    return one.unionByName(two)


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    answers = _answers(spark, sf_dir)
    evidence = _evidence(spark, sf_dir, answers)
    reports = verification.verify_answers(
        answers.select("answer_id", "video_id", "intent"), _claims(answers), evidence, answers.select("answer_id", "coverage")
    )
    return reports, evidence


@query(f"""WITH {_ANSWERS}
SELECT answer_id, CASE WHEN len(missing) = 0 THEN 'sufficient' ELSE 'insufficient' END AS status, len(missing) = 0 AND n > 0 AS direct_support,
  array_to_string(missing, ' ') AS missing_evidence, CAST(confidence AS DOUBLE) AS confidence,
  CASE WHEN len(missing) = 0 THEN 'answer' WHEN intent = 'visual' THEN 'increase_frame_density' WHEN intent = 'screen_text' THEN 'run_ocr'
       WHEN intent = 'global' THEN 'search_another_channel' ELSE 'find_second_evidence' END AS recommended_actions,
  concat_ws(',', 'doc_' || answer_id, CASE WHEN has_next = 1 AND wrong_next = 0 THEN 'doc_' || (answer_id + 1) END) AS verified_ids
FROM msg""")
def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, _ = _reports(spark, sf_dir)
    return reports.select(
        "answer_id",
        "status",
        "direct_support",
        F.array_join("missing_evidence", " ").alias("missing_evidence"),
        "confidence",
        F.array_join("recommended_actions", ",").alias("recommended_actions"),
        F.array_join("verified_ids", ",").alias("verified_ids"),
    )


@query(f"""WITH {_ANSWERS}
SELECT ev.answer_id, ev.evidence_id, ev.modality, CASE WHEN length(ev.text) > 500 THEN substr(ev.text, 1, 497) || '...' ELSE ev.text END AS excerpt
FROM ev JOIN ans USING (answer_id) WHERE ev.video_id = ans.video_id""")
def citation_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, evidence = _reports(spark, sf_dir)
    return verification.citations_of(reports, evidence).select("answer_id", "evidence_id", "modality", "excerpt")


@query(f"""WITH {_ANSWERS}
SELECT answer_id, array_to_string(list_filter([
    CASE WHEN has_next = 0 THEN 'Unknown evidence IDs were selected: doc_' || (answer_id + 1) || '.' END,
    CASE WHEN intent = 'visual' AND NOT has_visual THEN 'Visual evidence is required before answering this question.' END,
    CASE WHEN intent = 'screen_text' AND NOT has_ocr THEN 'OCR evidence is required before answering this question.' END,
    CASE WHEN intent = 'causal' AND n < 2 THEN 'The causal answer requires corroborating evidence.' END,
    CASE WHEN intent = 'global' AND coverage < 0.7 THEN 'Timeline coverage ' || format('{{:.2f}}', coverage) || ' is insufficient for a global or count answer.' END],
    lambda m: m IS NOT NULL), ' ') AS missing FROM agg""")
def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    decisions = _claims(answers).where("claim_no = 1").join(answers.select("answer_id", "intent"), "answer_id")
    gate = verification.answer_gate(
        decisions.select("answer_id", "intent", "evidence_ids"),
        _evidence(spark, sf_dir, answers),
        answers.select("answer_id", "coverage"),
    )
    return gate.select("answer_id", F.array_join("missing", " ").alias("missing"))


@query("""SELECT doc_id AS evidence_id, CASE WHEN length(text) > 1500 THEN substr(text, 1, 1497) || '...' ELSE text END AS text FROM documents""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("evidence_id"), "text", F.array().cast("array<string>").alias("artifacts")
    )
    return verification.evidence_summary(evidence)
