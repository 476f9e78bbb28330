"""Tokenising, indexing, full-text, dense and hybrid search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import tokenize
from tidemark.functions.vectors import normalize_vector
from tidemark.operators import artifacts, chunking, indexing, retrieval
from tidemark.operators.ranges import merge_ranges
from tidemark.queries import query
from tidemark.queries.segments import TURN_CHUNKS, _TURN_SQL
from tidemark.queries.sql import CHUNKS, IV, SEGS, grid_shots, merged
from tidemark.session import cut_lineage, ensure_checkpoint_dir, read_table, remove_folder
from tidemark.sources.inverted_index import search_index, write_inverted_index
from tidemark.sources.workload import (
    conversation_index,
    conversation_segments,
    document_index,
    embedding_index,
    event_intervals,
)
from tidemark.sources.workload import grid_shots as make_shots

SEARCH = "the with and that hahahe est les"
_TERMS = "('the'), ('with'), ('and'), ('that'), ('hahahe'), ('est'), ('les')"
_TOKENS = "list_transform(regexp_extract_all({text}, '[a-zA-Z0-9_]+|[㐀-鿿]'), lambda t: lower(t))"

_DOCS = """d AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, text, doc_id * 1000 AS start_ms, doc_id * 1000 + n_chars AS end_ms,
  lang, source FROM documents)"""
_TURNS = f"""{SEGS}, d AS (SELECT video_id, segment_id AS item_id, seg_text AS text, start_ms, end_ms, role FROM segs)"""


def bm25_sql(docs: str, where: str = "true", top_k: int = 20, scope: str = "") -> str:
    on = f"USING ({scope})" if scope else ""
    scope_list = f"{scope}, " if scope else ""
    partition = f"PARTITION BY {scope}" if scope else ""
    group = f"GROUP BY {scope}" if scope else ""
    stats_join = f"JOIN st {on}" if scope else "CROSS JOIN st"
    df_on = f"USING ({scope}, term)" if scope else "USING (term)"
    return f"""WITH {docs},
t AS (SELECT {scope_list}item_id, start_ms, end_ms, {_TOKENS.format(text='text')} AS tk FROM d WHERE {where}),
q(term) AS (VALUES {_TERMS}),
st AS (SELECT {scope_list}count(*) AS n, CASE WHEN avg(len(tk)) = 0 THEN 1.0 ELSE avg(len(tk)) END AS a FROM t {group}),
tf AS (SELECT {scope_list}item_id, start_ms, end_ms, len(tk) AS dl, term, CAST(len(list_filter(tk, lambda x: x = term)) AS DOUBLE) AS f FROM t, q),
df AS (SELECT {scope_list}term, count(*) AS df FROM tf WHERE f > 0 GROUP BY {scope_list}term),
sc AS (SELECT {scope_list}item_id, start_ms, end_ms,
  sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / a))) AS score
  FROM tf JOIN df {df_on} {stats_join} WHERE f > 0 GROUP BY {scope_list}item_id, start_ms, end_ms),
r AS (SELECT *, row_number() OVER ({partition} ORDER BY round(score, 9) DESC, start_ms, end_ms, item_id) AS rank FROM sc WHERE score > 0)
SELECT {scope_list}item_id, rank, round(score, 6) AS score FROM r WHERE rank <= {top_k}"""


def _hits(found: DataFrame, *scope: str) -> DataFrame:
    return found.select(*scope, "item_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(bm25_sql(_DOCS))
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(retrieval.bm25_search(document_index(spark, sf_dir), SEARCH, top_k=20))


@query(bm25_sql(_DOCS))
def bm25_search_prepared_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over a stored index: postings of the query's terms, opened where a hit can be."""
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    write_inverted_index(document_index(spark, sf_dir), path)
    hits, _ = search_index(spark, path, SEARCH, top_k=20)
    hits = cut_lineage(hits)
    remove_folder(spark, path)
    return _hits(hits)


@query(bm25_sql(_DOCS, "lang = 'fr'"))
def bm25_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics follow the tag filter, so scores differ from the unfiltered search."""
    where = retrieval.SearchFilter(all_tags=("fr",))
    return _hits(retrieval.bm25_search(document_index(spark, sf_dir), SEARCH, top_k=20, where=where))


@query(bm25_sql(_DOCS, "start_ms < 150500 AND 40200 < end_ms"))
def bm25_within_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = retrieval.SearchFilter(within=(40_200, 150_500))
    return _hits(retrieval.bm25_search(document_index(spark, sf_dir), SEARCH, top_k=20, where=where))


@query(bm25_sql(_DOCS, "source IN ('src3', 'src7') OR item_id = '11'"))
def bm25_any_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = retrieval.SearchFilter(any_source_ids=("src3", "src7", "11"))
    return _hits(retrieval.bm25_search(document_index(spark, sf_dir), SEARCH, top_k=20, where=where))


@query(bm25_sql(_TURNS, top_k=3, scope="video_id"))
def bm25_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index per conversation: statistics and ranks are per video."""
    found = retrieval.bm25_search(conversation_index(spark, sf_dir), SEARCH, top_k=3, scope=("video_id",))
    return _hits(found, "video_id")


@query(f"""SELECT doc_id, term, count(*) AS tf
FROM (SELECT doc_id, unnest({_TOKENS.format(text='text')}) AS term FROM documents) GROUP BY doc_id, term""")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.postings(read_table(spark, sf_dir, "documents"), ["doc_id"])


@query(f"""SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS mean_length, max(n) AS longest
FROM (SELECT lang, len({_TOKENS.format(text='text')}) AS n FROM documents) GROUP BY lang""")
def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = read_table(spark, sf_dir, "documents").select("lang", F.size(tokenize(F.col("text"))).cast("bigint").alias("n"))
    return lengths.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n").alias("n_tokens"),
        F.round(F.avg("n"), 6).alias("mean_length"),
        F.max("n").alias("longest"),
    )


_DENSE = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 7),
s AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, vec_id * 1000 AS start_ms, vec_id * 1000 + 1000 AS end_ms, label,
             list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS score FROM embeddings, q)"""


def _dense_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    index = embedding_index(spark, sf_dir)
    probe = read_table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()["embedding"]
    dimensions = len(probe)
    return index.withColumn("vector", normalize_vector(F.col("raw_vector"), dimensions)), list(probe)


@query(f"""WITH {_DENSE}, r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, start_ms, end_ms, item_id) AS rank FROM s WHERE score >= 0)
SELECT item_id, rank, round(score, 6) AS score FROM r WHERE rank <= 25""")
def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, probe = _dense_documents(spark, sf_dir)
    return _hits(retrieval.dense_search(documents, probe, len(probe), top_k=25))


@query(f"WITH {_DENSE} SELECT item_id, round(score, 6) AS score FROM s WHERE score >= 0.1 AND label = 3")
def dense_search_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match above the threshold."""
    documents, probe = _dense_documents(spark, sf_dir)
    where = retrieval.SearchFilter(all_tags=("3",))
    hits = retrieval.dense_search(documents, probe, len(probe), top_k=None, min_score=0.1, where=where)
    return _hits(hits).drop("rank")


@query("""SELECT c.conv_id AS video_id, CAST(c.turn AS VARCHAR) AS item_id,
  round(CAST(e.embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS first_value
FROM conversations c JOIN embeddings e ON e.vec_id // 4 = c.conv_id AND e.vec_id % 4 = c.turn""")
def dense_index_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations share their numbers; each takes the vector of its own conversation."""
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").cast("string").alias("item_id"), "text")
    vectors = read_table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("video_id"), (F.col("vec_id") % 4).cast("string").alias("item_id"), F.col("embedding").alias("vector")
    )
    size = vectors.select(F.size("vector")).first()[0]
    index = indexing.dense_index(turns, vectors, size)
    return index.select("video_id", "item_id", F.round(F.col("vector")[0].cast("double"), 5).alias("first_value"))


_SPARSE_50 = bm25_sql(_DOCS, top_k=50)


_FUSED = f"""sp AS ({_SPARSE_50}), {_DENSE},
de AS (SELECT * FROM (SELECT item_id, row_number() OVER (ORDER BY round(score, 9) DESC, start_ms, end_ms, item_id) AS rank FROM s
  WHERE score >= 0 AND item_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)) WHERE rank <= 50),
j AS (SELECT coalesce(sp.item_id, de.item_id) AS item_id, sp.rank AS sr, de.rank AS dr,
      coalesce(1.0::DOUBLE / (60 + sp.rank), 0) + coalesce(1.0::DOUBLE / (60 + de.rank), 0) AS rrf
      FROM sp FULL OUTER JOIN de ON sp.item_id = de.item_id),
k AS (SELECT j.*, row_number() OVER (ORDER BY round(rrf, 12) DESC, CAST(j.item_id AS BIGINT), j.item_id) AS rank FROM j)"""


def _hit_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The 50 best documents by terms and by vectors, as hits."""
    texts = document_index(spark, sf_dir)
    sparse = retrieval.bm25_search(texts, SEARCH, top_k=50, keep=("source_ids", "text"))
    vectors, probe = _dense_documents(spark, sf_dir)
    known = vectors.join(texts.select("item_id"), "item_id", "left_semi")
    nearest = retrieval.dense_search(known, probe, len(probe), top_k=50)
    # texts are fetched for the hits alone
    dense = texts.select("item_id", "source_ids", "text").join(F.broadcast(nearest), "item_id")

    def as_hits(found: DataFrame, name: str) -> DataFrame:
        # both lists place an item at its id, so equal ranks fall back to the same order
        return found.select(
            F.lit("corpus").alias("video_id"),
            F.lit("transcript").alias("modality"),
            "rank",
            "source_ids",
            (F.col("item_id").cast("bigint") * 1_000).alias("start_ms"),
            (F.col("item_id").cast("bigint") * 1_000 + 1).alias("end_ms"),
            "text",
            F.lit(None).cast("double").alias("confidence"),
            F.create_map(F.lit(name), F.col("score")).alias("scores"),
        )

    return as_hits(sparse, "bm25"), as_hits(dense, "cosine")


@query(f"""WITH {_FUSED}
SELECT item_id, rank, coalesce(sr, -1) AS sparse_rank, coalesce(dr, -1) AS dense_rank, round(rrf, 9) AS hybrid_rrf FROM k WHERE rank <= 30""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.hybrid_search(*_hit_lists(spark, sf_dir), top_k=30)
    return fused.select(
        F.col("source_id").alias("item_id"),
        F.col("rank").cast("bigint").alias("rank"),
        F.coalesce(F.col("sparse_rank"), F.lit(-1)).cast("bigint").alias("sparse_rank"),
        F.coalesce(F.col("dense_rank"), F.lit(-1)).cast("bigint").alias("dense_rank"),
        F.round("hybrid_rrf", 9).alias("hybrid_rrf"),
    )


def _with_frames(hits: DataFrame, sizes: tuple[int, ...], other: str) -> DataFrame:
    """Hits whose source ids also name pictures, and one id that is no picture."""
    number = F.col("source_ids")[0].cast("bigint")
    return hits.withColumn("source_ids", F.concat(F.slice("source_ids", 1, 1), F.array(F.lit(other), *[F.concat(F.lit("f"), number % n) for n in sizes])))


@query(f"""WITH {_FUSED},
fr AS (SELECT doc_id % 7 AS n, 'a' || CAST((doc_id % 7) % 4 AS VARCHAR) AS artifact_id, 'u' || CAST(doc_id % 7 AS VARCHAR) || '_' || CAST(count(*) AS VARCHAR) AS uri FROM documents GROUP BY doc_id % 7),
h AS (SELECT 0 AS l, item_id, rank, unnest([2, 3]) AS pos, unnest([CAST(item_id AS BIGINT) % 7, CAST(item_id AS BIGINT) % 5]) AS n FROM sp
  UNION ALL SELECT 1, item_id, rank, unnest([2, 3]), unnest([CAST(item_id AS BIGINT) % 5, CAST(item_id AS BIGINT) % 3]) FROM de),
a AS (SELECT h.item_id, l * 100000 + h.rank * 100 + pos AS spot, artifact_id, uri FROM h JOIN fr USING (n)),
m AS (SELECT item_id, artifact_id, min(spot) AS first, max_by(uri, spot) AS uri FROM a GROUP BY item_id, artifact_id)
SELECT k.rank, m.item_id, row_number() OVER (PARTITION BY m.item_id ORDER BY first) - 1 AS place, artifact_id, uri FROM m JOIN k USING (item_id) WHERE k.rank <= 30""")
def hit_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of fused hits: those of both lists, once each, where they are met first and as they are named last."""
    sparse, dense = _hit_lists(spark, sf_dir)
    sparse, dense = _with_frames(sparse, (7, 5), "none"), _with_frames(dense, (5, 3), "none")
    number = (F.col("doc_id") % 7).cast("bigint")
    frames = read_table(spark, sf_dir, "documents").groupBy(number.alias("n")).agg(F.count(F.lit(1)).alias("size"))
    frames = frames.select(
        F.lit("corpus").alias("video_id"), F.concat(F.lit("f"), "n").alias("frame_id"),
        F.concat(F.lit("a"), F.col("n") % 4).alias("artifact_id"), F.concat(F.lit("u"), "n", F.lit("_"), "size").alias("uri"),
    )
    pictures = artifacts.distinct_artifacts([artifacts.hit_artifacts(hits, frames) for hits in (sparse, dense)])
    fused = retrieval.hybrid_search(sparse, dense, top_k=30)
    found = artifacts.fused_artifacts(fused, pictures)
    return found.select(F.col("rank").cast("bigint").alias("rank"), F.col("source_id").alias("item_id"), "place", "artifact_id", "uri")


@query(f"""WITH {_FUSED}
SELECT item_id, CAST(rank AS BIGINT) AS rank, concat_ws(',', item_id, 's', CASE WHEN dr IS NOT NULL AND sr IS NOT NULL THEN 'd' END) AS source_ids,
  round(coalesce(1.0::DOUBLE / (60 + sr), 0), 9) AS rrf_sparse, round(coalesce(1.0::DOUBLE / (60 + dr), 0), 9) AS rrf_dense,
  concat_ws(',', CASE WHEN sr IS NOT NULL THEN 'bm25' END, CASE WHEN dr IS NOT NULL THEN 'cosine' END) AS score_names
FROM k WHERE rank <= 30 AND sr IS NOT NULL
UNION ALL SELECT item_id, CAST(rank AS BIGINT), item_id || ',d', 0, round(1.0::DOUBLE / (60 + dr), 9), 'cosine' FROM k WHERE rank <= 30 AND sr IS NULL""")
def hybrid_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids and scores of fused hits: those of both lists, the sparse list's first."""
    sparse, dense = _hit_lists(spark, sf_dir)
    tagged = lambda hits, tag: hits.withColumn("source_ids", F.concat(F.slice("source_ids", 1, 1), F.array(F.lit(tag))))
    fused = retrieval.hybrid_search(tagged(sparse, "s"), tagged(dense, "d"), top_k=30)
    part = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c)
    return fused.select(
        F.col("source_id").alias("item_id"), F.col("rank").cast("bigint").alias("rank"), F.array_join("source_ids", ",").alias("source_ids"),
        part("rrf_sparse"), part("rrf_dense"), F.array_join(F.array_sort(F.map_keys("scores")), ",").alias("score_names"),
    )


# ---- index documents ---------------------------------------------------------

@query(f"""WITH RECURSIVE {SEGS}, {_TURN_SQL}, {CHUNKS}, {grid_shots('segs')},
tg AS (SELECT video_id, chunk_no, tag, min(place) AS place FROM (
  SELECT l.video_id, l.chunk_no, 'en' AS tag, l.ord * 2 AS place FROM labelled l
  UNION ALL SELECT l.video_id, l.chunk_no, s.role, l.ord * 2 + 1 FROM labelled l JOIN segs s USING (video_id, segment_id)) GROUP BY ALL),
tags AS (SELECT video_id, chunk_no AS ord, string_agg(tag, ',' ORDER BY place) AS tags FROM tg GROUP BY video_id, chunk_no),
sh AS (SELECT c.video_id, c.ord, string_agg(s.shot_id, ',' ORDER BY s.ord) AS shot_ids
       FROM chunks c JOIN shots s ON s.video_id = c.video_id AND s.start_ms < c.end_ms AND c.start_ms < s.end_ms GROUP BY c.video_id, c.ord)
SELECT 'chunk_' || c.video_id || '_' || lpad(CAST(c.ord AS VARCHAR), 6, '0') AS item_id, c.start_ms, c.end_ms, c.text, tags.tags,
       'chunk_' || c.video_id || '_' || lpad(CAST(c.ord AS VARCHAR), 6, '0') || ',' || c.segment_ids || ',' || sh.shot_ids AS source_ids
FROM chunks c JOIN tags USING (video_id, ord) JOIN sh USING (video_id, ord)""")
def transcript_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = chunking.ChunkParams(target_characters=600, max_characters=2_000, context_padding_ms=0)
    segments = conversation_segments(spark, sf_dir)
    chunks = chunking.with_inspection(chunking.build_chunks(segments, params), make_shots(segments), params)
    documents = indexing.transcript_documents(segments, chunks)
    return _documents(documents)


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(
        "item_id", "start_ms", "end_ms", "text",
        F.array_join("tags", ",").alias("tags"), F.array_join("source_ids", ",").alias("source_ids"),
    )


_DESCRIBED = f"""{IV}, v AS (SELECT * FROM iv WHERE event_type = 'view'),
pu AS (SELECT * FROM iv WHERE event_type = 'purchase'), er AS (SELECT * FROM iv WHERE event_type = 'error'), {merged('pu', 'p')}, {merged('er', 'e')},
ci AS (SELECT v.event_id, string_agg('c' || p.start_ms, ',' ORDER BY p.start_ms) AS ids FROM v JOIN p ON p.video_id = v.video_id AND p.start_ms < v.end_ms AND v.start_ms < p.end_ms GROUP BY v.event_id),
si AS (SELECT v.event_id, string_agg('s' || e.start_ms, ',' ORDER BY e.start_ms) AS ids FROM v JOIN e ON e.video_id = v.video_id AND e.start_ms < v.end_ms AND v.start_ms < e.end_ms GROUP BY v.event_id)"""


@query(f"""WITH {_DESCRIBED}
SELECT 'd' || v.event_id AS item_id, v.start_ms, v.end_ms, 'view of ' || v.video_id AS text, 'view' AS tags,
       concat_ws(',', 'd' || v.event_id, 'f' || v.event_id, ci.ids, si.ids) AS source_ids
FROM v LEFT JOIN ci USING (event_id) LEFT JOIN si USING (event_id)""")
def visual_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = event_intervals(spark, sf_dir)
    views = iv.where("event_type = 'view'")
    descriptions = views.select(
        "video_id",
        F.concat(F.lit("d"), F.col("event_id")).alias("description_id"),
        F.concat(F.lit("view of "), F.col("video_id")).alias("text"),
        "start_ms",
        "end_ms",
        F.array(F.concat(F.lit("f"), F.col("event_id"))).alias("frame_ids"),
        F.array(F.lit("view")).alias("tags"),
    )

    def spans(kind: str, id_column: str, letter: str) -> DataFrame:
        return merge_ranges(iv.where(F.col("event_type") == kind)).select(
            "video_id",
            F.concat(F.lit(letter), F.col("start_ms")).alias(id_column),
            F.col("start_ms").alias("ord"),
            "start_ms",
            "end_ms",
        )

    documents = indexing.visual_documents(
        descriptions, spans("purchase", "chunk_id", "c"), spans("error", "shot_id", "s"), disjoint=True
    )
    return _documents(documents)


@query(f"""WITH RECURSIVE {SEGS}, {_TURN_SQL}, {CHUNKS},
h AS (SELECT video_id, segment_id, ord, row_number() OVER (PARTITION BY video_id ORDER BY length(seg_text) DESC, ord) AS rank FROM segs)
SELECT h.video_id, h.rank, l.chunk_no AS chunk_ord FROM h JOIN labelled l ON l.video_id = h.video_id AND l.segment_id = h.segment_id""")
def hit_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits named by segment ids are mapped to the chunk that holds the first known id."""
    from pyspark.sql import Window

    segments = conversation_segments(spark, sf_dir)
    chunks = chunking.build_chunks(segments, TURN_CHUNKS)
    owner = chunks.select("video_id", F.explode("segment_ids").alias("segment_id"), "chunk_id")
    longest = Window.partitionBy("video_id").orderBy(F.length("normalized_text").desc(), "ord")
    ranked = segments.withColumn("rank", F.row_number().over(longest))
    hits = ranked.join(owner, ["video_id", "segment_id"]).select(
        "video_id", F.col("rank").cast("bigint").alias("rank"), F.array("segment_id", "chunk_id").alias("source_ids")
    )
    matched = retrieval.first_known_chunk(hits, chunks)
    return matched.select("video_id", "rank", F.col("chunk.ord").alias("chunk_ord"))


@query("""WITH l AS (SELECT doc_id AS video_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
o AS (SELECT video_id, lang, n, trim(line) AS t, (n // 3) * 1000 AS ts FROM l WHERE trim(line) <> ''),
s AS (SELECT video_id, t, min(n) AS first, min(ts) AS s, max(ts) + 1 AS e, list(n ORDER BY n) AS ns, min(lang) AS lang FROM o GROUP BY video_id, t HAVING count(*) > 1),
d AS (SELECT video_id, 's' || CAST(first AS VARCHAR) AS item_id, t, s, e, lang,
  list_concat(['s' || CAST(first AS VARCHAR)], list_transform(ns, lambda x: 'o' || CAST(x AS VARCHAR)), list_transform(list_sort(list_distinct(list_transform(ns, lambda x: x // 3))), lambda x: 'f' || CAST(x AS VARCHAR))) AS own FROM s
  UNION ALL SELECT video_id, 'o' || CAST(n AS VARCHAR), t, ts, ts + 1, lang, ['o' || CAST(n AS VARCHAR), 'f' || CAST(n // 3 AS VARCHAR)] FROM o WHERE video_id NOT IN (SELECT video_id FROM s))
SELECT video_id, item_id, s AS start_ms, e AS end_ms, t AS text, coalesce(lang, '') AS tags,
  array_to_string(list_concat(own, list_transform(range(s // 10000, (e - 1) // 10000 + 1), lambda k: 'c' || CAST(k AS VARCHAR))), ',') AS source_ids FROM d""")
def ocr_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as on-screen text, three a second: repeated lines are spans, videos without one fall back to single observations."""
    lines = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    observed = cut_lineage(lines.where("trim(line) <> ''").select(
        "video_id", F.concat(F.lit("o"), "n").alias("observation_id"), F.concat(F.lit("f"), F.floor(F.col("n") / 3)).alias("frame_id"),
        F.trim("line").alias("normalized_text"), (F.floor(F.col("n") / 3) * 1_000).cast("bigint").alias("timestamp_ms"), F.col("lang").alias("language"), "n",
    ))
    place = F.array_sort(F.collect_list(F.struct("n", "observation_id")))
    # stored, since it is read three times: every line's text is shuffled once
    spans = cut_lineage(observed.groupBy("video_id", F.col("normalized_text").alias("text")).agg(
        F.concat(F.lit("s"), F.min("n")).alias("span_id"), F.min("timestamp_ms").alias("start_ms"), (F.max("timestamp_ms") + 1).alias("end_ms"), place.alias("p"),
    ).where(F.size("p") > 1).withColumn("observation_ids", F.col("p.observation_id")).drop("p"))
    grid = observed.groupBy("video_id").agg(F.max("timestamp_ms").alias("last")).select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / 10_000))).alias("ord"))
    chunks = grid.select("video_id", F.concat(F.lit("c"), "ord").alias("chunk_id"), "ord", (F.col("ord") * 10_000).alias("start_ms"), (F.col("ord") * 10_000 + 10_000).alias("end_ms"))
    documents = indexing.ocr_documents(observed.drop("n"), spans, chunks, disjoint=True)
    return documents.select("video_id", "item_id", "start_ms", "end_ms", "text", F.array_join("tags", ",").alias("tags"), F.array_join("source_ids", ",").alias("source_ids"))
