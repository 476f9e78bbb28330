"""Full-text and dense search over index documents, and rank fusion of two lists.

Index documents: ``item_id, start_ms, end_ms, source_ids, tags`` plus ``text`` or
a prepared ``token_counts``/``doc_length`` pair, plus ``vector`` for dense search.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import overlaps
from tidemark.functions.text import query_terms, tokenize
from tidemark.functions.vectors import dot, unit_query
from tidemark.session import cut_lineage

K1 = 1.5
B = 0.75


@dataclass(frozen=True)
class SearchFilter:
    """Structured restriction of an index: a time range, any source id, all tags."""

    within: tuple[int, int] | None = None
    any_source_ids: tuple[str, ...] = ()
    all_tags: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.within is not None and not 0 <= self.within[0] < self.within[1]:
            raise ValueError("within must be a non-empty range")
        for name in ("any_source_ids", "all_tags"):
            values = getattr(self, name)
            if len(set(values)) != len(values) or any(not v.strip() for v in values):
                raise ValueError(f"{name} must be unique and non-blank")

    def apply(self, documents: DataFrame) -> DataFrame:
        kept = documents
        if self.within is not None:
            low, high = self.within
            kept = kept.where(overlaps("start_ms", "end_ms", F.lit(low), F.lit(high)))
        if self.any_source_ids:
            wanted = F.array(*[F.lit(v) for v in self.any_source_ids])
            kept = kept.where(F.arrays_overlap(F.col("source_ids"), wanted))
        if self.all_tags:
            wanted = F.array(*[F.lit(v) for v in self.all_tags])
            kept = kept.where(F.size(F.array_except(wanted, F.col("tags"))) == 0)
        return kept


def _check(query: str, top_k: int | None) -> None:
    if not query.strip():
        raise ValueError("query must not be empty")
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be positive")


def _rank(scored: DataFrame, scope: Sequence[str], top_k: int | None) -> DataFrame:
    """The first ``top_k`` hits with their rank; all hits, unranked, without a limit."""
    if top_k is None:
        return scored.withColumn("rank", F.lit(None).cast("int"))
    order = [F.col("score").desc(), "start_ms", "end_ms", "item_id"]
    if scope:
        window = Window.partitionBy(*scope).orderBy(*order)
        return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_k)
    top = scored.orderBy(*order).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def bm25_search(
    documents: DataFrame,
    query: str,
    top_k: int = 10,
    min_score: float = 0.0,
    where: SearchFilter = SearchFilter(),
    scope: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Ranked BM25 hits.

    Statistics come from the documents that pass ``where``.  ``scope`` names the
    columns that separate indexes (``("video_id",)`` = one index per video);
    empty means one corpus.  Only the query's terms are counted, inside the scan
    stage: per document a length and one small array leave it, nothing is
    exploded or shuffled but the statistics.  ``keep`` columns are fetched for
    the hits alone.
    """
    _check(query, top_k)
    terms = Counter(query_terms(query))
    scope, keep = list(scope), list(keep)
    columns = [*scope, "item_id", "start_ms", "end_ms"]
    kept = where.apply(documents)
    term_list = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    if "token_counts" in documents.columns:
        counted = kept.select(
            *columns, F.col("doc_length").cast("bigint").alias("_length"), "token_counts", term_list.alias("_terms")
        )
        frequency = "transform(_terms, t -> cast(coalesce(try_element_at(token_counts, t), 0) AS bigint))"
    else:
        # explode(array(x)) keeps x from being computed again wherever it is used:
        # the optimizer neither merges projections nor pushes filters through it
        tokens = kept.select(*columns, F.explode(F.array(tokenize(F.col("text")))).alias("_tokens"))
        matched = F.filter("_tokens", lambda token: token.isin(*terms))
        counted = tokens.select(
            *columns, F.size("_tokens").cast("bigint").alias("_length"), F.explode(F.array(matched)).alias("_matched"),
            term_list.alias("_terms"),
        )
        frequency = "transform(_terms, t -> cast(size(filter(_matched, m -> m = t)) AS bigint))"
    prepared = counted.select(*columns, "_length", F.expr(frequency).alias("_tf"))
    if "token_counts" not in documents.columns:
        # texts are parsed once: statistics and scores both read the stored counts
        prepared = cut_lineage(prepared)
    held = ", ".join(f"count_if(_tf[{i}] > 0)" for i in range(len(terms)))
    stats = prepared.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_length").alias("avgdl"),
        F.expr(f"array({held})" if terms else "array(0L)").alias("df"),
    )
    matching = prepared.where("exists(_tf, f -> f > 0)")
    if scope:
        joined = matching.join(stats.select(*scope, F.struct("n", "avgdl", "df").alias("_stats")), scope)
    else:
        joined = matching.withColumn("_stats", stats.select(F.struct("n", "avgdl", "df")).scalar())
    average = "CASE WHEN _stats.avgdl = 0 THEN 1D ELSE _stats.avgdl END"
    # one summand per query term, added in query order
    score = F.expr(
        " + ".join(
            f"{weight} * ln(1D + (_stats.n - _stats.df[{i}] + 0.5D) / (_stats.df[{i}] + 0.5D))"
            f" * _tf[{i}] * ({K1}D + 1D) / (_tf[{i}] + {K1}D * (1D - {B}D + {B}D * _length / ({average})))"
            for i, weight in enumerate(terms.values())
        )
        or "0D"
    )
    scored = joined.select(*columns, score.alias("score")).where(
        (F.col("score") > 0) & (F.col("score") >= min_score)
    )
    hits = _rank(scored, scope, top_k)
    if not keep:
        return hits
    payload = documents.select(*scope, "item_id", *keep)
    # without a scope there are at most top_k hits, so they can go to the documents
    few = hits if scope else F.broadcast(hits)
    return payload.join(few, [*scope, "item_id"])


def dense_search(
    documents: DataFrame,
    query_vector: Sequence[float],
    dimensions: int,
    top_k: int | None = 10,
    min_score: float = 0.0,
    where: SearchFilter = SearchFilter(),
    scope: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Exact cosine hits over unit ``vector`` columns; filters run before scoring.

    ``top_k=None`` returns every match of the threshold, without ranks.
    """
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be positive")
    if not -1.0 <= min_score <= 1.0:
        raise ValueError("min_score must be between -1 and 1")
    unit = unit_query(list(query_vector), dimensions)
    query = F.array(*[F.lit(v) for v in unit])
    scored = (
        where.apply(documents)
        .select(
            *scope, "item_id", "start_ms", "end_ms", *keep, dot(F.col("vector"), query).alias("score")
        )
        .where(F.col("score") >= min_score)
    )
    return _rank(scored, list(scope), top_k)


def hybrid_search(
    sparse: DataFrame,
    dense: DataFrame,
    top_k: int = 10,
    rrf_k: int = 60,
    sparse_weight: float = 1.0,
    dense_weight: float = 1.0,
    scope: Sequence[str] = ("video_id",),
) -> DataFrame:
    """Reciprocal-rank fusion of a sparse and a dense hit list.

    Hits carry ``rank, modality, source_ids, start_ms, end_ms, text, scores``.
    Two hits are the same item when modality and first source id agree.  The
    sparse hit's payload wins unless it has no text.  Both lists are unioned and
    grouped once - one shuffle instead of a full outer join and two look-backs.
    """
    if top_k <= 0 or rrf_k <= 0 or min(sparse_weight, dense_weight) < 0:
        raise ValueError("top_k and rrf_k must be positive, weights non-negative")
    scope = list(scope)
    payload = F.struct("start_ms", "end_ms", "text", "confidence")
    columns = [*scope, "modality", "rank", "source_ids", "start_ms", "end_ms", "text", "confidence", "scores"]
    hits = sparse.select(*columns, F.lit(0).alias("list_no")).unionByName(
        dense.select(*columns, F.lit(1).alias("list_no"))
    )
    place = F.struct("list_no", "rank")
    grouped = (
        hits.withColumn("source_id", F.col("source_ids")[0])
        .groupBy(*scope, "modality", "source_id")
        .agg(
            F.max(F.when(F.col("list_no") == 0, F.col("rank"))).alias("sparse_rank"),
            F.max(F.when(F.col("list_no") == 1, F.col("rank"))).alias("dense_rank"),
            F.coalesce(
                F.min_by(F.when(F.col("text").isNotNull(), payload), F.when(F.col("text").isNotNull(), place)),
                F.min_by(payload, place),
            ).alias("item"),
            # one entry per list the item appears in
            F.array_sort(
                F.collect_list(F.struct("list_no", "rank", "source_ids", "scores")),
                lambda a, b: F.when(a["list_no"] != b["list_no"], a["list_no"] - b["list_no"]).otherwise(
                    a["rank"] - b["rank"]
                ).cast("int"),
            ).alias("related"),
        )
    )
    part_sparse = F.lit(float(sparse_weight)) / (F.lit(rrf_k) + F.col("sparse_rank"))
    part_dense = F.lit(float(dense_weight)) / (F.lit(rrf_k) + F.col("dense_rank"))
    score = F.coalesce(part_sparse, F.lit(0.0)) + F.coalesce(part_dense, F.lit(0.0))
    fused = grouped.select(
        *scope,
        "modality",
        "source_id",
        F.col("item.start_ms").alias("start_ms"),
        F.col("item.end_ms").alias("end_ms"),
        F.col("item.text").alias("text"),
        F.col("item.confidence").alias("confidence"),
        F.array_distinct(F.flatten(F.transform("related", lambda r: r["source_ids"]))).alias("source_ids"),
        F.aggregate(
            F.transform("related", lambda r: r["scores"]),
            F.create_map().cast("map<string,double>"),
            later_wins,
        ).alias("scores"),
        "sparse_rank",
        "dense_rank",
        part_sparse.alias("rrf_sparse"),
        part_dense.alias("rrf_dense"),
        score.alias("hybrid_rrf"),
    )
    order = [F.col("hybrid_rrf").desc(), "start_ms", "end_ms", "source_id"]
    if scope:
        window = Window.partitionBy(*scope).orderBy(*order)
        return fused.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_k)
    return fused.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def later_wins(first: Column, second: Column) -> Column:
    """Merge two maps; on a shared key the second value stays."""
    second = F.coalesce(second, F.create_map().cast("map<string,double>"))
    return F.map_concat(
        F.map_filter(first, lambda key, _: ~F.array_contains(F.map_keys(second), key)), second
    )


def first_known_chunk(hits: DataFrame, chunks: DataFrame, scope: Sequence[str] = ("video_id",)) -> DataFrame:
    """Attach to each hit the first of its source ids that is a chunk id; others drop out."""
    scope = list(scope)
    known = chunks.select(
        *scope,
        F.col("chunk_id").alias("source_id"),
        F.struct(*[c for c in chunks.columns if c not in scope]).alias("chunk"),
    )
    position = hits.select(*scope, "rank", F.posexplode("source_ids").alias("pos", "source_id"))
    matched = (
        position.join(known, [*scope, "source_id"])
        .groupBy(*scope, "rank")
        .agg(F.min_by("chunk", "pos").alias("chunk"))
    )
    return hits.join(matched, [*scope, "rank"])
