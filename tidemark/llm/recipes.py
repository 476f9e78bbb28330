"""Exact duplicates by content-defined chunk recipes.

A text without its white space is cut where a rolling hash of its last bytes has
a given form, so equal content is cut alike.  Every distinct chunk is moved once
and its digest is verified against its bytes; a digest that proves to belong to
one content only is an identifier.  Texts are equal when their ordered lists of
identifiers are, and only those short lists are grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext
from tidemark.session import cut_lineage

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class ChunkRule:
    """Chunk sizes in bytes, and the digest lengths to try until no two contents share one."""

    least: int = 512
    most: int = 16_384
    mean_bits: int = 11
    digest_bytes: tuple[int, ...] = (16, 32, 64)


def _gear() -> np.ndarray:
    """256 pseudo-random words, by the mixing rule."""
    return (bytetext.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def cut_points(data: np.ndarray, mean_bits: int) -> np.ndarray:
    """Positions after which the rolling hash of the last 32 bytes allows a cut."""
    rolled = _GEAR[data]
    width = 1
    while width < 32:
        shifted = np.zeros_like(rolled)
        shifted[width:] = rolled[:-width] << np.uint32(width)
        rolled = rolled + shifted
        width *= 2
    return np.flatnonzero(rolled >> np.uint32(32 - mean_bits) == 0) + 1


def chunk_edges(cuts: np.ndarray, start: int, end: int, rule: ChunkRule) -> list[int]:
    """Edges of the chunks of one text within a slice; they depend on the text alone."""
    edges = [start]
    inner = cuts[np.searchsorted(cuts, start + rule.least) : np.searchsorted(cuts, end)].tolist()
    for cut in [*inner, end]:
        if cut - edges[-1] < rule.least and cut != end:
            continue
        while cut - edges[-1] > rule.most:
            edges.append(edges[-1] + rule.most)
        if cut > edges[-1]:
            edges.append(cut)
    return edges


def _chunks(raw: list[bytes], rule: ChunkRule) -> Iterator[list[bytes]]:
    """The chunks of each text of a slice."""
    texts = [t.translate(None, SPACES) for t in raw]
    whole = b"".join(texts)
    cuts = cut_points(np.frombuffer(whole, np.uint8), rule.mean_bits)
    at = 0
    for text in texts:
        edges = chunk_edges(cuts, at, at + len(text), rule)
        at += len(text)
        yield [whole[a:b] for a, b in zip(edges, edges[1:])]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def recipes(docs: DataFrame, rule: ChunkRule, size: int) -> DataFrame:
    """``(doc_id, n_points, text_sha256, recipe)``: the recipe is the digests one after the other."""
    texts = bytetext.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytetext.slices(batches):
            lists, hashes = [], []
            for chunks in _chunks(bytetext.as_bytes(part.column("text")), rule):
                sha = hashlib.sha256()
                for chunk in chunks:
                    sha.update(chunk)
                hashes.append(sha.hexdigest())
                lists.append(b"".join(_digest(c, size) for c in chunks))
            points = pc.cast(pc.utf8_length(part.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), points, pa.array(hashes, pa.string()), pa.array(lists, pa.binary())],
                ["doc_id", "n_points", "text_sha256", "recipe"],
            )

    return texts.mapInArrow(run, f"doc_id {kind}, n_points bigint, text_sha256 string, recipe binary")


def distinct_chunks(docs: DataFrame, rule: ChunkRule, size: int) -> DataFrame:
    """``(digest, content)`` of the distinct chunks; a task sends each content once while it remembers it."""
    bytetext.small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for part in bytetext.slices(batches):
            digests, contents = [], []
            for chunks in _chunks(bytetext.as_bytes(part.column("text")), rule):
                for chunk in chunks:
                    mark = hashlib.blake2b(chunk, digest_size=32).digest()
                    if mark not in sent:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(mark)
                        digests.append(_digest(chunk, size))
                        contents.append(chunk)
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(contents, pa.binary())], ["digest", "content"])

    return texts.mapInArrow(run, "digest binary, content binary").distinct()


def verified_recipes(docs: DataFrame, rule: ChunkRule = ChunkRule()) -> DataFrame:
    """The recipes under the shortest digest of which no two contents share a value."""
    for size in rule.digest_bytes:
        shared = distinct_chunks(docs, rule, size).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if shared.isEmpty():
            return recipes(docs, rule, size)
    raise ValueError("two chunks share the longest digest")


def exact_duplicates(docs: DataFrame, rule: ChunkRule = ChunkRule()) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``.

    Texts are equal when they agree after deleting space, tab, line feed, vertical
    tab, form feed and carriage return; null counts as empty.  Of equal texts the
    one with most code points stays, then the smallest ``doc_id`` (null ids last).
    Repeated rows count each; rows repeated under the kept id all say kept.  Other
    columns are ignored.
    """
    rows = cut_lineage(verified_recipes(docs, rule))
    best = F.min_by("doc_id", F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id")))
    # stored, so that the join below is dealt by itself and a large group can be split there
    groups = cut_lineage(rows.groupBy("recipe").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return rows.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_distinct(docs: DataFrame, rule: ChunkRule = ChunkRule()) -> DataFrame:
    """The rows of ``docs`` whose text stays, all columns as they came."""
    kept = exact_duplicates(docs, rule).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
