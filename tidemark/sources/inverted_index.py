"""A stored inverted index with block maxima: full-text search that reads only what can be among the best.

Documents are put in order of length and cut into ranges of ``RANGE_DOCS``; a block holds what one
term has in one range: its postings and the highest impact among them, that is, the BM25
term weight without its idf.  Blocks lie in folders by a hash of the term, sorted by term,
so a query opens the files of its own terms only.

A search reads the maxima first, which are one number a block.  Their weighted sum over the
query's terms bounds every score in a range.  The most promising ranges are scored exactly; the
k-th best score found there is one the answer cannot fall below, and of the other ranges only those
whose bound reaches it are opened.  All of a document's postings lie in its own range, so
every score is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.text import query_terms, tokenize
from tidemark.operators.retrieval import K1, B
from tidemark.session import cut_lineage, remove_folder

#: Documents of a range: a power of two, and how many folders the terms are dealt into.
RANGE_BITS = 7
RANGE_DOCS = 1 << RANGE_BITS
FOLDERS = 16
#: The folder of what the ranges hold.
DOCUMENTS = -1


@dataclass(frozen=True)
class SearchCost:
    """Blocks of the query's terms, and how many of them were opened."""

    blocks: int
    opened: int


_BLOCKS = (
    "range bigint, term string, n bigint, best double, places array<smallint>, tfs array<int>, "
    "documents array<struct<item_id:string,start_ms:bigint,end_ms:bigint,doc_length:bigint>>"
)


def _blocks_of(number: int, rows: pa.Table, average: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The row of a range's documents, then its blocks; a place counts the range's documents."""
    rows = rows.combine_chunks()
    columns = [rows.column(f.name).combine_chunks().cast(f.type) for f in schema.field("documents").type.value_type]
    listed = pa.ListArray.from_arrays([0, len(rows)], pa.StructArray.from_arrays(columns, fields=list(schema.field("documents").type.value_type)))
    yield pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip((number, None, len(rows), None, None, None), schema)] + [listed.cast(schema.field("documents").type)], schema=schema
    )
    coded = pa.concat_arrays([c.flatten() for c in rows.column("tokens").chunks]).dictionary_encode()
    if not len(coded):
        return
    lengths = rows.column("doc_length").to_numpy()
    places = np.repeat(np.arange(len(rows)), lengths)
    keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(rows) + places, return_counts=True)
    terms, places = np.divmod(keys, len(rows))
    first = np.flatnonzero(np.diff(terms, prepend=-1))
    impact = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * lengths[places] / average))
    ends = [*first.tolist(), len(keys)]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(first), number), pa.int64()),
            coded.dictionary.take(pa.array(terms[first])).cast(pa.string()),
            pa.array(np.diff(ends), pa.int64()),
            pa.array(np.maximum.reduceat(impact, first)),
            pa.ListArray.from_arrays(ends, pa.array(places, pa.int16())).cast(schema.field("places").type),
            pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())).cast(schema.field("tfs").type),
            pa.nulls(len(first), schema.field("documents").type),
        ],
        schema=schema,
    )


def write_inverted_index(documents: DataFrame, path: str) -> None:
    """Store the index of ``item_id, start_ms, end_ms, text``; null texts have no terms.

    ``blocks``: ``folder, term, range, n, best, places, tfs``, and for each range a row without a term that holds its
    ``documents`` (folder -1); ``corpus``: one row of the number of documents and their average length.
    What is dealt out is every text once, in order of length, and then the finished blocks: documents
    of a range follow each other in one task, which needs no rows of single postings.
    """
    tokens = F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>"))
    spark, texts = documents.sparkSession, f"{path}/texts"
    documents.select("item_id", "start_ms", "end_ms", "text", F.size(tokens).cast("bigint").alias("doc_length")).write.parquet(texts)
    sized = spark.read.parquet(texts)
    sized.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_length").alias("average")).coalesce(1).write.parquet(f"{path}/corpus")
    average = spark.read.parquet(f"{path}/corpus").first()["average"] or 1.0
    # position in the order of length, counted inside each task; the tasks hold ranges of lengths
    placed = sized.repartitionByRange("doc_length", "item_id").sortWithinPartitions("doc_length", "item_id")
    placed = placed.select(F.shiftright(F.monotonically_increasing_id(), RANGE_BITS).alias("range"), "item_id", "start_ms", "end_ms", "doc_length", tokens.alias("tokens"))
    schema = to_arrow_schema(T.StructType.fromDDL(_BLOCKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pieces = None, []
        for batch in batches:
            ranges = batch.column("range").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if pieces and ranges[a] != number:
                    yield from _blocks_of(number, pa.Table.from_batches(pieces), average, schema)
                    pieces = []
                number = int(ranges[a])
                pieces.append(batch.slice(a, b - a))
        if pieces:
            yield from _blocks_of(number, pa.Table.from_batches(pieces), average, schema)

    blocks = placed.mapInArrow(cut, _BLOCKS)
    folder = F.when(F.col("term").isNull(), F.lit(DOCUMENTS)).otherwise(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
    blocks.withColumn("folder", folder).repartition("folder").sortWithinPartitions("folder", "term", "range").write.partitionBy("folder").parquet(f"{path}/blocks")
    remove_folder(spark, texts)


def search_index(spark: SparkSession, path: str, query: str, top_k: int = 10, probe_ranges: int = 8) -> tuple[DataFrame, SearchCost]:
    """``(hits, cost)``: the hits of ``bm25_search`` over the indexed documents, and what was read for them.

    The driver sees the document frequencies of the query's terms, one score and two counts.
    """
    if not query.strip() or top_k <= 0:
        raise ValueError("query must not be empty and top_k positive")
    terms = Counter(query_terms(query))
    blocks = spark.read.parquet(f"{path}/blocks")
    mine = blocks.where(F.col("term").isin(*terms) if terms else F.lit(False))
    if terms:
        folders = [r[0] for r in spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(FOLDERS)).cast("int") for t in terms]))).distinct().collect()]
        mine = mine.where(F.col("folder").isin(*folders))
    corpus = spark.read.parquet(f"{path}/corpus").first()
    average = corpus["average"] or 1.0
    held = {r["term"]: r["df"] for r in mine.groupBy("term").agg(F.sum("n").alias("df")).collect()}

    def idf(term: str):
        return f"ln(1D + ({corpus['n']} - {held[term]} + 0.5D) / ({held[term]} + 0.5D))"

    found = {t: weight for t, weight in terms.items() if t in held}
    schema = "item_id string, start_ms bigint, end_ms bigint, score double, rank int"
    if not found:
        return spark.createDataFrame([], schema), SearchCost(0, 0)
    weights = F.coalesce(*[F.when(F.col("term") == t, F.expr(f"{weight} * {idf(t)}")) for t, weight in found.items()])
    bounds = cut_lineage(mine.groupBy("range").agg(F.sum(weights * F.col("best")).alias("bound"), F.count(F.lit(1)).alias("n_blocks")))
    tfs = [F.max(F.when(F.col("term") == t, F.col("p.tfs"))).alias(f"_tf{i}") for i, t in enumerate(found)]
    # the same summands in the same order as a search over texts
    score = " + ".join(
        f"{weight} * {idf(t)} * coalesce(_tf{i}, 0) * ({K1}D + 1D) / (coalesce(_tf{i}, 0) + {K1}D * (1D - {B}D + {B}D * doc_length / {average!r}D))"
        for i, (t, weight) in enumerate(found.items())
    )

    def scored(ranges: DataFrame) -> DataFrame:
        opened = mine.join(ranges.select("range"), "range", "left_semi").select("range", "term", F.explode(F.arrays_zip("places", "tfs")).alias("p"))
        counted = opened.groupBy("range", F.col("p.places").cast("int").alias("place")).agg(*tfs)
        named = blocks.where(F.col("folder") == DOCUMENTS).join(ranges.select("range"), "range", "left_semi")
        named = named.select("range", F.posexplode("documents").alias("place", "d")).select("range", "place", "d.*")
        rows = counted.join(named, ["range", "place"])
        return rows.select("item_id", "start_ms", "end_ms", F.expr(score).alias("score")).where("score > 0")

    probed = bounds.orderBy(F.desc("bound"), "range").limit(probe_ranges)
    least = scored(probed).orderBy(F.desc("score")).limit(top_k).agg(F.min("score"), F.count(F.lit(1))).first()
    floor = least[0] if least[1] == top_k else 0.0
    # a bound is rounded differently from the scores below it
    kept = bounds.where(F.col("bound") >= floor * (1 - 1e-9))
    cost = bounds.agg(F.sum("n_blocks"), F.sum(F.when(F.col("bound") >= floor * (1 - 1e-9), F.col("n_blocks")))).first()
    order = [F.desc("score"), "start_ms", "end_ms", "item_id"]
    top = scored(kept).orderBy(*order).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))), SearchCost(int(cost[0] or 0), int(cost[1] or 0))
