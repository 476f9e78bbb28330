"""SimHash near-duplicates found with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Two
fingerprints at two or fewer differing bits agree on some segment wholly, and
in every case on one of the pairs (1,2), (2,3), (3,1) such that the first
segment has no error and the second at most one.  The exact segment is joined
with the fuzzy hash of the other: the indices of all codewords of the perfect
binary (23, 12) Golay code within distance four of the (zero-padded) segment.
A word at distance one from another shares with it the codeword nearest to
either, so every link shares a key.  Each fingerprint has 16 keys on average.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext
from tidemark.llm.components import connected_components
from tidemark.session import cut_lineage

SEED = 42
MAX_BITS = 2
_GENERATOR = 0b101011100011
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_PAIRS = ((0, 1), (1, 2), (2, 0))


@dataclass(frozen=True)
class SimHashRule:
    """Shingle length, and the bucket size from which pairs give way to midpoints."""

    words: int = 3
    pair_limit: int = 16


def fingerprint(text: bytes, size: int) -> int:
    """Majority bits of XXH64 over all shingles of ``size`` lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    n = len(words) - size + 1
    for at in range(0, n, 8192):
        piece = words[at : min(at + 8192, n) + size - 1]
        hashes = np.array([digest(b" ".join(t), SEED) for t in zip(*(piece[k:] for k in range(size)))], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(docs: DataFrame, rule: SimHashRule = SimHashRule()) -> DataFrame:
    """``(doc_id, fp)`` of every row, the fingerprint as a signed 64-bit number."""
    size = rule.words
    texts = bytetext.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytetext.slices(batches):
            found = np.array([fingerprint(t, size) for t in bytetext.as_bytes(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return texts.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    out = words.copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, _GENERATOR << (bit - 11), 0)
    return out


def _cosets() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes, the error patterns of at most four bits (padded) and their number."""
    patterns = [0] + [sum(1 << b for b in bits) for k in range(1, 5) for bits in combinations(range(23), k)]
    patterns = np.array(patterns, np.int64)
    of = _syndromes(patterns)
    order = np.argsort(of, kind="stable")
    count = np.bincount(of, minlength=2048)
    table = np.zeros((2048, count.max()), np.int64)
    place = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    table[of[order], place] = patterns[order]
    return table, count


_TABLE, _COUNT = _cosets()


def fuzzy_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within distance four of each segment: (which segment, index)."""
    syndrome = _syndromes(segment)
    n = _COUNT[syndrome]
    row = np.repeat(np.arange(len(segment)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    codeword = segment[row] ^ _TABLE[syndrome[row], place]
    # the code is systematic: the upper twelve bits number its codewords
    return row, codeword >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, key) for all keys of signed 64-bit fingerprints."""
    whole = fps.view(np.uint64)
    parts = [(whole >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in _SEGMENTS]
    rows, keys = [], []
    for number, (exact, fuzzy) in enumerate(_PAIRS):
        row, index = fuzzy_indices(parts[fuzzy])
        rows.append(row)
        keys.append((np.int64(number) << 34) | (parts[exact][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def links(distinct: DataFrame, rule: SimHashRule = SimHashRule()) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that join all of two or fewer differing bits.

    Buckets of at most ``pair_limit`` fingerprints are verified pair by pair.
    In larger ones no pairs are made: every fingerprint is hung on the 65 words at
    distance one or less, and those that meet on a word are at most two bits apart,
    so a star on each word links exactly what is to be linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                fps = batch.column("fp").slice(at, 50_000).to_numpy(zero_copy_only=False).astype(np.int64)
                row, key = golay_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(run, "key bigint, fp bigint")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(keyed.join(sizes, "key"))
    cold, hot = shared.where(F.col("n") <= rule.pair_limit), shared.where(F.col("n") > rule.pair_limit)
    pairs = (
        cold.select("key", F.col("fp").alias("a"))
        .join(cold.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )
    words = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0))) for k in range(64)))
    near = hot.select("fp").distinct().select(F.col("fp").alias("b"), F.explode(words).alias("word"))
    star = near.groupBy("word").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("word", "a")
    return pairs.union(near.join(star, "word").where("a < b").select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, rule: SimHashRule = SimHashRule()) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of two or fewer
    differing fingerprint bits, itself included.  Null texts count as empty; texts
    without words have fingerprint zero and are linked like any other.  Repeated
    rows give repeated results; other columns are ignored; ids must not be null
    (such rows keep a null component).

    Equal fingerprints are folded to one before anything is joined, so a group of
    copies costs one row; the link search moves 16 bytes-sized rows, never texts.
    """
    fps = cut_lineage(fingerprints(docs, rule))
    groups = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges = links(groups, rule)
    name = lambda side: groups.select(F.col("fp").alias(side), F.col("first_id").alias(f"{side}_id"))
    ids = edges.join(name("a"), "a").join(name("b"), "b").where("a_id is not null and b_id is not null")
    classes = connected_components(ids.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    labelled = groups.join(classes, groups["first_id"] == classes["node"], "left").select(
        "fp", F.coalesce("component", "first_id").alias("component_id")
    )
    return fps.join(labelled, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, rule: SimHashRule = SimHashRule()) -> DataFrame:
    """One row of each near-duplicate class of ``docs``: that of its smallest ``doc_id``.

    Rows repeated under the same id are one document and leave one row; rows with
    a null id are kept.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), rule).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
