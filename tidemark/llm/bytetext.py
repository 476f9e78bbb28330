"""Texts of Arrow batches as flat byte arrays, and the vectorised steps on them.

Everything here works on one bounded slice of a batch at a time; the arrays of a
slice are a small multiple of its text bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1


#: Rows and bytes of an Arrow batch: texts are long, and a worker and its executor hold a few batches at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session hand texts to Python in batches of bounded size; a longer text comes alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_and_text(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only the key and the text, null texts as empty; other columns never reach Python."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bounded_sample(rows: DataFrame, key: str, group: str, per_group: int, groups: int) -> DataFrame:
    """``(key, group)`` of at most ``per_group`` rows of each of the ``groups`` most frequent groups.

    Rows are taken in the order of a hash of their key.  Group sizes tell how far
    down that order the sample can reach, so that only a small multiple of it is sorted.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(groups).collect()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = F.lit(False)
    for r in counts:
        chosen = chosen | ((F.col(group) == r[group]) & (place <= min(1.0, 4 * (per_group + 16) / r["n"])))
    order = Window.partitionBy(group).orderBy(place, key)
    return rows.where(chosen).select(key, group).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_group).drop("_place")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with at most ``limit`` text bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = offsets_of(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def offsets_of(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    raw = array.buffers()[1]
    if raw is None or not raw.size:
        return np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(raw, kind, len(array) + 1, array.offset * kind().itemsize).astype(np.int64)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each text begins."""
    offsets = offsets_of(array)
    raw = array.buffers()[2]
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(raw, np.uint8, size, int(offsets[0])) if raw is not None and size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def as_bytes(array: pa.Array) -> list[bytes]:
    data, offsets = flat(array)
    whole = data.tobytes()
    edges = offsets.tolist()
    return [whole[a:b] for a, b in zip(edges, edges[1:])]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs, none of which crosses a text border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(inside))]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[borders - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


class Powers:
    """Powers of the hash base and of its inverse, grown to the longest slice seen."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of one running polynomial sum."""
    up, down = powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes; runs may cross texts, the caller drops those."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * _BASE + words[k : k + n] + np.uint64(k + 1))
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def letters_table() -> np.ndarray:
    """True for bytes of words: ASCII letters and digits, and every byte of other characters."""
    table = np.zeros(256, bool)
    for first, last in ((48, 57), (65, 90), (97, 122), (128, 255)):
        table[first : last + 1] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table
