"""Collocations: phrases that occur more often than their parts would by chance.

Frequent phrases are found by dynamic itemset counting.  The corpus is dealt into
``shards``, which are scanned in turn, over and over.  Words are counted from the first
scan on.  As soon as both phrases of one word less that a phrase contains have reached the
threshold, wherever in the cycle that is, the phrase is activated: it is counted from the
next scan on until it has seen every shard once, interleaved with shorter and longer ones
that began earlier or later.  The scans end when nothing is active any more.

Words become 64-bit ids, proven to differ for different words, and texts blocks of ids that
every scan reads instead of the texts.  A scan tests sub-phrases in a table of
``filter_slots`` bytes, which holds the latest scan a phrase of that slot was reached in; the
table has one size, however large the corpus is, and only its filled slots are broadcast.  Phrases that share a slot can only cause
needless counts: what counts is decided by exact joins on the few phrases near the threshold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bytetext
from tidemark.session import cut_lineage, ensure_checkpoint_dir

UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = bytetext.lower_table()
#: Bytes that end a piece of text, and those that end a word besides.
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[10, 11, 12, 13, *b".,;:!?"]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[9, 32]] = True
_WORD_BYTES = 8
_COUNTS = "lang string, phrase binary, n bigint"
_REACHED = "lang string, phrase binary, reach int"


@dataclass(frozen=True)
class PhraseRule:
    """Longest phrase, least occurrences, shards of a cycle, and phrases reported for each language.

    ``filter_slots``: bytes of the table a scan tests sub-phrases in; what is broadcast is at most five times that.  ``block_words`` and ``held_words`` bound what a worker holds.
    """

    longest: int = 5
    least: int = 100
    shards: int = 3
    top: int = 2000
    filter_slots: int = 1 << 24
    block_words: int = 1 << 16
    held_words: int = 1 << 20
    slice_bytes: int = 1 << 20


def _cuts(data: np.ndarray, limit: int) -> list[int]:
    """Where to cut a long text: between pieces, about every ``limit`` bytes."""
    ends = np.flatnonzero(_ENDS_PIECE[data]) if len(data) > limit else np.zeros(0, np.int64)
    out = [0]
    while len(data) - out[-1] > limit:
        k = int(np.searchsorted(ends, out[-1] + limit, "right")) - 1
        if k < 0 or ends[k] < out[-1]:
            k = int(np.searchsorted(ends, out[-1]))
        if k >= len(ends):
            break
        out.append(int(ends[k]) + 1)
    return [*out, len(data)]


def encode(docs: DataFrame, rule: PhraseRule, seed: int) -> DataFrame:
    """``(shard, lang, ids, words)``: blocks of word ids with a zero between pieces, and words new to the worker.

    ``ids`` are 8 bytes each, little-endian; ``words`` lists ``(id, word)``.
    """
    bytetext.small_batches(docs.sparkSession)
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(rule.shards)).cast("int").alias("shard"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    entry = pa.list_(pa.struct([("id", pa.binary()), ("word", pa.string())]))
    schema = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("ids", pa.binary()), ("words", entry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen, fresh = bytetext.Powers(), set(), []
        open_blocks: dict[tuple[int, str], list[np.ndarray]] = {}
        held: dict[tuple[int, str], int] = {}

        def block(key):
            ids = np.concatenate(open_blocks.pop(key))
            held.pop(key)
            out = pa.RecordBatch.from_pylist([{"shard": key[0], "lang": key[1], "ids": ids.tobytes(), "words": list(fresh)}], schema=schema)
            fresh.clear()
            return out

        def add(key, data, offsets):
            starts, ends = bytetext.runs(~_ENDS_WORD[data], offsets)
            if not len(starts):
                return
            data = _LOWER[data]
            ids = bytetext.mix(bytetext.span_hashes(data, starts, ends, powers) ^ np.uint64(seed))
            ids[ids == 0] = 1
            pieces = np.cumsum(_ENDS_PIECE[data])[starts]
            breaks = np.flatnonzero(pieces[1:] != pieces[:-1]) + 1
            values, first = np.unique(ids, return_index=True)
            if len(seen) > rule.held_words:
                seen.clear()
            for value, at in zip(values.tolist(), first.tolist()):
                if value not in seen:
                    seen.add(value)
                    fresh.append({"id": value.to_bytes(8, "little"), "word": data[starts[at] : ends[at]].tobytes().decode()})
            open_blocks.setdefault(key, []).append(np.append(np.insert(ids, breaks, 0), np.uint64(0)))
            held[key] = held.get(key, 0) + len(ids) + len(breaks) + 1

        for part in bytetext.slices(batches, limit=rule.slice_bytes):
            data, offsets = bytetext.flat(part.column("text"))
            keys = zip(part.column("shard").to_pylist(), part.column("lang").to_pylist())
            for key, a, b in zip(keys, offsets.tolist(), offsets[1:].tolist()):
                cuts = _cuts(data[a:b], rule.slice_bytes)
                for c, d in zip(cuts, cuts[1:]):
                    add(key, data[a + c : a + d], np.array([0, d - c]))
                    if held.get(key, 0) >= rule.block_words:
                        yield block(key)
        for key in list(open_blocks):
            yield block(key)

    return rows.mapInArrow(run, "shard int, lang string, ids binary, words array<struct<id: binary, word: string>>")


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _longer(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of one word less and their last words."""
    return bytetext.mix(hashes * _BASE + ids)


def _slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes % np.uint64(size)).astype(np.int64)


def active_phrases(lang: str, ids: np.ndarray, table: np.ndarray, scan: int, rule: PhraseRule) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, places, hashes)`` of the phrases of a block that are counted in this scan."""
    word = ids != 0
    hashes = bytetext.mix(ids ^ _lang_hash(lang))
    whole = word
    if scan < rule.shards:
        places = np.flatnonzero(word)
        yield 1, places, hashes[places]
    for length in range(2, rule.longest + 1):
        if len(hashes) < 2:
            return
        reached = np.where(whole, table[_slots(hashes, len(table))], 0)
        if not reached.any():
            return
        left, right = reached[:-1], reached[1:]
        whole = whole[:-1] & word[length - 1 :]
        active = whole & (left > 0) & (right > 0) & (np.maximum(left, right) > scan - rule.shards)
        hashes = _longer(hashes[:-1], ids[length - 1 :])
        places = np.flatnonzero(active)
        if len(places):
            yield length, places, hashes[places]


def _count_blocks(blocks: DataFrame, table: np.ndarray, scan: int, rule: PhraseRule) -> DataFrame:
    """``(lang, phrase, n)`` of one scan, added up inside each worker as far as it holds them."""
    filled = np.flatnonzero(table)
    shared = blocks.sparkSession.sparkContext.broadcast((filled.astype(np.int32), table[filled]))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])

    def counted(lang: str, length: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, words = np.concatenate([h for h, _ in parts]), np.concatenate([w for _, w in parts])
        order = np.argsort(hashes, kind="stable")
        hashes, words = hashes[order], words[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (words[1:] != words[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        raw = np.ascontiguousarray(words[first]).tobytes()
        phrases = pa.Array.from_buffers(pa.binary(length * _WORD_BYTES), len(first), [None, pa.py_buffer(raw)]).cast(pa.binary())
        n = pa.array(np.diff(np.append(first, len(hashes))), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(first), np.int32))), phrases, n], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, parts, held = np.zeros(rule.filter_slots, np.uint8), {}, 0
        reached[shared.value[0]] = shared.value[1]
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), bytetext.as_bytes(batch.column("ids"))):
                ids = np.frombuffer(raw, np.uint64)
                for length, places, hashes in active_phrases(lang, ids, reached, scan, rule):
                    words = ids[places[:, None] + np.arange(length)]
                    parts.setdefault((lang, length), []).append((hashes, words))
                    held += len(places) * length
                if held > rule.held_words:
                    yield from (counted(*key, value) for key, value in parts.items())
                    parts, held = {}, 0
        yield from (counted(*key, value) for key, value in parts.items())

    found = blocks.select("lang", "ids").mapInArrow(run, _COUNTS)
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


#: Phrases that are broadcast where they are counted and found to be no more; beyond, both sides are shuffled.
SMALL_ROWS = 100_000


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` of phrases, stored, and marked for broadcast if few."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else rows


def _length(phrase: str = "phrase") -> Column:
    return (F.octet_length(phrase) / _WORD_BYTES).cast("int")


def _counted_when_active(rows: DataFrame, reached: DataFrame, rule: PhraseRule) -> DataFrame:
    """Of ``rows (lang, phrase, scan, n)`` those of the one cycle in which the phrase was active."""
    part = lambda name: reached.select("lang", F.col("phrase").alias(name), F.col("reach").alias(f"{name}_reach"))
    split = rows.withColumns({"init": F.expr(f"substring(phrase, 1, octet_length(phrase) - {_WORD_BYTES})"), "tail": F.expr(f"substring(phrase, {_WORD_BYTES + 1})")})
    both = split.join(part("init"), ["lang", "init"], "left").join(part("tail"), ["lang", "tail"], "left")
    since = F.when(_length() == 1, F.lit(0)).otherwise(F.when(F.col("init_reach").isNotNull() & F.col("tail_reach").isNotNull(), F.greatest("init_reach", "tail_reach") + 1))
    return both.where((F.col("scan") >= since) & (F.col("scan") < since + rule.shards)).select("lang", "phrase", "scan", "n")


class _Folder:
    """Tables of one run in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{ensure_checkpoint_dir(spark)}/phrases-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, *parts: str) -> None:
        df.write.option("compression", "zstd").partitionBy(*parts).parquet(f"{self.path}/{name}")

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def remove(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def _encoded(docs: DataFrame, folder: _Folder, rule: PhraseRule) -> tuple[DataFrame, DataFrame]:
    """``(blocks, vocabulary)``, stored, with ids that differ for different words."""
    for seed in range(16):
        name = f"blocks{seed}"
        folder.write(encode(docs, rule, seed), name, "shard")
        blocks = folder.read(name, "lang string, ids binary, words array<struct<id: binary, word: string>>, shard int")
        words = blocks.select(F.explode("words").alias("w")).select("w.id", "w.word")
        check = words.select("id", F.xxhash64("word").alias("other")).groupBy("id").agg((F.min("other") != F.max("other")).alias("clash"))
        if check.where("clash").isEmpty():
            return blocks, words
    raise RuntimeError("word ids collide under every seed")


def frequent_phrases(docs: DataFrame, folder: _Folder, rule: PhraseRule = PhraseRule()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(totals, sizes, vocabulary)``: phrases of ``least`` occurrences, words of each language, texts of ids."""
    blocks, vocabulary = _encoded(docs, folder, rule)
    table = np.zeros(rule.filter_slots, np.uint8)
    latest, scan = -1, 0
    # one table of all scans each, so that plans stay as small as they are in the first scan
    reached = folder.spark.createDataFrame([], _REACHED)
    while scan < rule.shards or latest >= scan - rule.shards:
        folder.write(_count_blocks(blocks.where(F.col("shard") == scan % rule.shards), table, scan, rule), f"counts/scan={scan}")
        everything = folder.read("counts", f"{_COUNTS}, scan int")
        # a phrase that is reached has its share of the threshold in one scan of its cycle at least
        window = everything.where(F.col("scan") > scan - rule.shards)
        near = window.where(F.col("n") * rule.shards >= rule.least).select("lang", "phrase").distinct().join(reached, ["lang", "phrase"], "left_anti")
        # the counts of three scans are many, the phrases looked for among them few
        rows = _counted_when_active(window.join(_small(near), ["lang", "phrase"]), reached, rule)
        now = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= rule.least)
        folder.write(now.select("lang", "phrase"), f"reached/reach={scan}")
        reached = folder.read("reached", _REACHED)
        if _mark(reached.where((F.col("reach") == scan) & (_length() < rule.longest)), table, scan, rule):
            latest = scan
        scan += 1
    totals = _counted_when_active(everything.join(_small(reached.select("lang", "phrase")), ["lang", "phrase"]), reached, rule)
    totals = cut_lineage(totals.groupBy("lang", "phrase").agg(F.sum("n").alias("a")))
    sizes = everything.where((F.col("scan") < rule.shards) & (_length() == 1)).groupBy("lang").agg(F.sum("n").alias("size"))
    return totals, cut_lineage(sizes), vocabulary


def _mark(fresh: DataFrame, table: np.ndarray, scan: int, rule: PhraseRule) -> bool:
    """Enter phrases just reached into the table; only their distinct slots come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, raw in zip(batch.column("lang").to_pylist(), bytetext.as_bytes(batch.column("phrase"))):
                ids = np.frombuffer(raw, np.uint64)
                hashes = bytetext.mix(ids[:1] ^ _lang_hash(lang))
                for k in range(1, len(ids)):
                    hashes = _longer(hashes, ids[k : k + 1])
                out.append(int(_slots(hashes, rule.filter_slots)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], ["slot"])

    slots = fresh.mapInArrow(run, "slot int").distinct().toArrow().column("slot").to_numpy()
    table[slots] = scan + 1
    return bool(len(slots))


def _scored(totals: DataFrame, sizes: DataFrame, rule: PhraseRule) -> DataFrame:
    """``(lang, phrase, a, l, r, size, score)`` of the phrases of two words or more that no longer one stands for."""
    candidates = cut_lineage(totals.where(_length() > 1).withColumn("k", _length()))
    inside = candidates.where("k > 2").select("lang", "a", "k", "phrase", F.explode(F.expr("sequence(2, k - 1)")).alias("length"))
    inside = inside.select("lang", "a", "phrase", "length", F.explode(F.expr("sequence(0, k - length)")).alias("at"))
    covered = inside.groupBy("lang", F.expr(f"substring(phrase, at * {_WORD_BYTES} + 1, length * {_WORD_BYTES})").alias("phrase")).agg(F.max("a").alias("over"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").where("over is null or over < a")
    cuts = kept.select("lang", "phrase", "a", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.withColumns({"first": F.expr(f"substring(phrase, 1, cut * {_WORD_BYTES})"), "rest": F.expr(f"substring(phrase, cut * {_WORD_BYTES} + 1)")})
    part = lambda name, count: totals.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    # 17 digits hold every count of a corpus of 10 ** 17 words; products are exact in 38
    wide = lambda c: f"cast({c} as decimal(17, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * ({wide('a')} * {wide('size')})) div ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "size")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.size", "best.score")


def collocations(docs: DataFrame, rule: PhraseRule = PhraseRule()) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language.

    Texts are cut at ``. , ; : ! ?`` and line ends into pieces and those at blanks and tabs into
    words, A-Z lower-cased.  ``a`` counts a phrase's occurrences inside pieces, overlapping
    ones too, ``n`` all words of the language (null: ``und``).  ``score`` is
    ``1000 * a * n / (l * r)`` rounded down, at the cut into a first part of ``l`` and a rest
    of ``r`` occurrences where it is least; of equal cuts the earliest.  Phrases that occur
    only inside a longer one of the list are left out.  Ties: more occurrences, then bytes.
    Null texts are empty, repeated rows count as often as they stand there, other columns
    are ignored.  No text, no phrases.
    """
    folder = _Folder(docs.sparkSession)
    totals, sizes, vocabulary = frequent_phrases(docs.select("doc_id", "lang", "text"), folder, rule)
    scored = cut_lineage(_scored(totals, sizes, rule))
    order = [F.desc("score"), F.desc("a")]
    # every phrase that ties with the last one stays until texts decide
    ahead = cut_lineage(scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= rule.top))
    spread = ahead.select("lang", "phrase", F.explode(F.expr(f"sequence(0, cast(octet_length(phrase) / {_WORD_BYTES} as int) - 1)")).alias("at"))
    spread = spread.withColumn("id", F.expr(f"substring(phrase, at * {_WORD_BYTES} + 1, {_WORD_BYTES})"))
    words = vocabulary.join(spread.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("word").alias("word"))
    texts = spread.join(words, "id").groupBy("lang", "phrase").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = ahead.join(texts, ["lang", "phrase"]).withColumn("phrase", F.array_join("words.word", " "))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("bigint"))
    found = cut_lineage(ranked.where(F.col("rank") <= rule.top).select("lang", "rank", "phrase", "a", "l", "r", F.col("size").alias("n"), "score"))
    folder.remove()
    return found
