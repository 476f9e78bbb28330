"""Fusing several retrieval lists into ranked, chunk-aligned candidate windows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.folds import Extent, fold_groups
from tidemark.plans.ordered import ScanPolicy, ordered
from tidemark.plans.overlap import overlap_join
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class FusionParams:
    top_k: int = 8
    rrf_k: int = 60
    max_gap_ms: int = 2_000
    max_window_ms: int = 30_000
    align_to_chunks: bool = True
    modality_weights: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.top_k <= 0 or self.rrf_k <= 0 or self.max_window_ms <= 0 or self.max_gap_ms < 0:
            raise ValueError("top_k, rrf_k and max_window_ms must be positive, max_gap_ms non-negative")
        if any(weight < 0 for weight in self.modality_weights.values()):
            raise ValueError("modality weights must be non-negative")


def fuse_evidence(hits: DataFrame, params: FusionParams = FusionParams()) -> DataFrame:
    """Accumulate weight/(rrf_k+rank) per (video, modality, first source id).

    ``hits``: ``video_id, list_no, rank, modality, source_ids, start_ms, end_ms,
    text``.  The earliest hit gives the payload.  All aggregates combine
    map-side, so a source hit by every list costs one row per map task.
    """
    weight = F.lit(1.0)
    if params.modality_weights:
        table = F.create_map(
            *[F.lit(x) for pair in params.modality_weights.items() for x in pair]
        )
        weight = F.coalesce(F.try_element_at(table, F.col("modality")).cast("double"), F.lit(1.0))
    place = F.struct("list_no", "rank")
    payload = F.struct("start_ms", "end_ms", "source_ids", "text")
    return (
        hits.withColumn("source_id", F.col("source_ids")[0])
        .groupBy("video_id", "modality", "source_id")
        .agg(
            F.sum(weight / (F.lit(params.rrf_k) + F.col("rank"))).alias("score"),
            F.min_by(payload, place).alias("_item"),
            F.min(place).alias("_seen"),
        )
        .select(
            "video_id",
            "modality",
            "source_id",
            "_item.*",
            "score",
            F.col("_seen.list_no").alias("first_list"),
            F.col("_seen.rank").alias("first_rank"),
        )
    )


class _ClusterRule:
    """Open cluster: earliest start and latest end."""

    def __init__(self, max_gap_ms: int, max_window_ms: int) -> None:
        self.max_gap_ms, self.max_window_ms = max_gap_ms, max_window_ms
        self.low = self.high = 0

    def __call__(self, row: tuple, fresh: bool) -> bool:
        start, end, chunk_start = row
        if not fresh:
            near = start <= self.high + self.max_gap_ms
            same_chunk = chunk_start is not None and chunk_start < self.high
            high = max(self.high, end)
            if (near or same_chunk) and high - self.low <= self.max_window_ms:
                self.high = high
                return False
        self.low, self.high = start, end
        return True

    def state(self) -> list:
        return [self.low, self.high]

    def resume(self, state: list) -> None:
        self.low, self.high = state


def cluster_evidence(
    evidence: DataFrame,
    chunks: DataFrame,
    params: FusionParams = FusionParams(),
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Add ``cluster_no`` (0-based per video) to evidence rows.

    Evidence is walked in (range, -score) order and joins the latest cluster when
    it is near it or shares a chunk with it, and the hull stays within the
    window.  A chunk overlapping the item always ends after the cluster's start,
    so sharing one reduces to "the earliest chunk overlapping the item starts
    before the cluster's end" - one number per item instead of a chunk list.
    """
    items = evidence.select("video_id", "modality", "source_id", "start_ms", "end_ms")
    spans = chunks.select(
        "video_id", F.col("start_ms").alias("r_start_ms"), F.col("end_ms").alias("r_end_ms")
    )
    first_chunk = (
        overlap_join(items, spans)
        .groupBy("video_id", "modality", "source_id")
        .agg(F.min("r_start_ms").alias("_chunk_start"))
    )
    rows = evidence.join(first_chunk, ["video_id", "modality", "source_id"], "left").withColumn(
        "_falling", -F.col("score")
    )
    order = ["start_ms", "end_ms", "_falling", "first_list", "first_rank", "modality", "source_id"]
    scan = ordered(rows, ["video_id"], order, policy)
    max_gap, max_window = params.max_gap_ms, params.max_window_ms
    # beyond everything before it, and in no chunk that reaches back there
    apart = (F.col("start_ms") > F.col("_reach") + max_gap) & (
        F.col("_chunk_start").isNull() | (F.col("_chunk_start") >= F.col("_reach"))
    )
    return fold_groups(
        scan,
        {"_reach": ("max", F.col("end_ms"))},
        apart,
        ["start_ms", "end_ms", "_chunk_start"],
        lambda: _ClusterRule(max_gap, max_window),
        "cluster_no",
        Extent(0, 1, max_window),
    ).drop("_chunk_start", "_falling")


def candidate_windows(
    hits: DataFrame,
    chunks: DataFrame,
    shots: DataFrame,
    params: FusionParams = FusionParams(),
    policy: ScanPolicy | None = None,
) -> DataFrame:
    """Top windows per video with aligned range, evidence, modalities, chunk and shot ids.

    Clusters are ranked on scalars first; lists are collected only for the
    ``top_k`` windows that survive, and each window is at most ``max_window_ms``
    long.  The fused evidence, the clusters and the winners each have several
    readers and are stored once.
    """
    evidence = cut_lineage(fuse_evidence(hits, params))
    clustered = cut_lineage(cluster_evidence(evidence, chunks, params, policy))
    scalars = clustered.groupBy("video_id", "cluster_no").agg(
        F.sum("score").alias("fusion_rrf"),
        F.min("start_ms").alias("raw_start_ms"),
        F.max("end_ms").alias("raw_end_ms"),
        F.array_sort(F.collect_set("modality")).alias("modalities"),
    )
    ranking = Window.partitionBy("video_id").orderBy(
        F.col("fusion_rrf").desc(), "raw_start_ms", "raw_end_ms"
    )
    top = cut_lineage(
        scalars.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= params.top_k)
    )
    spans = chunks.select(
        "video_id",
        "chunk_id",
        F.col("ord").alias("r_ord"),
        F.col("start_ms").alias("r_start_ms"),
        F.col("end_ms").alias("r_end_ms"),
    )
    raw = top.select("video_id", "rank", F.col("raw_start_ms").alias("start_ms"), F.col("raw_end_ms").alias("end_ms"))
    hulls = (
        overlap_join(raw, spans.drop("chunk_id", "r_ord"))
        .groupBy("video_id", "rank")
        .agg(F.min("r_start_ms").alias("_lo"), F.max("r_end_ms").alias("_hi"))
    )
    fits = F.lit(params.align_to_chunks) & (F.col("_hi") - F.col("_lo") <= params.max_window_ms)
    windows = (
        top.join(hulls, ["video_id", "rank"], "left")
        .withColumns(
            {
                "start_ms": F.when(fits, F.col("_lo")).otherwise(F.col("raw_start_ms")),
                "end_ms": F.when(fits, F.col("_hi")).otherwise(F.col("raw_end_ms")),
                "modality_count": F.size("modalities").cast("double"),
            }
        )
        .drop("_lo", "_hi")
    )
    members = (
        clustered.join(top.select("video_id", "cluster_no", "rank"), ["video_id", "cluster_no"])
        .groupBy("video_id", "rank")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("start_ms", "end_ms", (-F.col("score")).alias("s"), "first_list", "first_rank", "modality", "source_id")
                )
            ).alias("_members")
        )
        .select(
            "video_id",
            "rank",
            F.transform("_members", lambda m: F.concat_ws(":", m["modality"], m["source_id"])).alias("evidence_keys"),
        )
    )
    keyed = windows.select("video_id", "rank", "start_ms", "end_ms")
    chunk_ids = _collect_ids(overlap_join(keyed, spans), "chunk_id", "chunk_ids")
    shot_spans = shots.select(
        "video_id",
        "shot_id",
        F.col("ord").alias("r_ord"),
        F.col("start_ms").alias("r_start_ms"),
        F.col("end_ms").alias("r_end_ms"),
    )
    shot_ids = _collect_ids(overlap_join(keyed, shot_spans), "shot_id", "shot_ids")
    none = F.array().cast("array<string>")
    return (
        windows.join(members, ["video_id", "rank"])
        .join(chunk_ids, ["video_id", "rank"], "left")
        .join(shot_ids, ["video_id", "rank"], "left")
        .select(
            "video_id",
            "rank",
            "start_ms",
            "end_ms",
            "modalities",
            "modality_count",
            "fusion_rrf",
            "evidence_keys",
            F.coalesce("chunk_ids", none).alias("chunk_ids"),
            F.coalesce("shot_ids", none).alias("shot_ids"),
        )
    )


def _collect_ids(pairs: DataFrame, id_column: str, output: str) -> DataFrame:
    ids = F.array_sort(F.collect_list(F.struct("r_ord", id_column)))
    return pairs.groupBy("video_id", "rank").agg(
        F.transform(ids, lambda entry: entry[id_column]).alias(output)
    )
