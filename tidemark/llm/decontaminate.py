"""Containment search of short test items inside long documents.

The items are partitioned by size.  In a size class whose largest member has
``u`` shingles, each item is represented by its bottom-k MinHash sketch with
``k = floor((1 - t) * u) + 1``.  A document that contains at least the share
``t`` of an item misses at most ``k - 1`` of its shingles, so it holds one of the
``k`` sketched ones: looking up every document shingle among the sketches misses
no document, however long.  Candidates are verified by exact shingle
containment on the words themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext


@dataclass(frozen=True)
class Containment:
    """Shingle length, threshold, and how many item bytes one scan of the documents may carry."""

    words: int = 5
    threshold: float = 0.8
    block_bytes: int = 8 << 20

    def need(self, n: int) -> int:
        """Fewest shared shingles of an item with ``n`` that reach the threshold."""
        return max(1, math.ceil(self.threshold * n - 1e-9))


def normal_words(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_PLAIN).split()


_PLAIN = bytes(int(c) if ok else 32 for c, ok in zip(bytetext.lower_table(), bytetext.letters_table()))


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words; fewer words make one shingle, none make none."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(t) for t in zip(*(words[k:] for k in range(size)))]


def _word_hash(words: list[bytes], powers: bytetext.Powers) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    return bytetext.span_hashes(np.frombuffer(b"".join(words), np.uint8), starts, ends, powers)


class ItemBlock:
    """A bounded set of items with their sketches, as the document scan needs them."""

    def __init__(self, items: list[tuple[object, bytes]], rule: Containment) -> None:
        powers = bytetext.Powers()
        self.rule = rule
        self.items: list[tuple[object, dict[bytes, int], bool]] = []
        classes: dict[int, list[int]] = defaultdict(list)
        hashes: list[np.ndarray] = []
        for item_id, text in items:
            words = normal_words(text)
            texts = shingles(words, rule.words)
            if not texts:
                continue
            short = len(words) < rule.words
            own = bytetext.shingle_hashes(_word_hash(words, powers), len(words) if short else rule.words)
            classes[len(set(texts)).bit_length()].append(len(self.items))
            self.items.append((item_id, dict.fromkeys(texts, 0), short))
            hashes.append(np.unique(own))
        keys: dict[int, set[int]] = defaultdict(set)
        self.short_sizes = sorted({next(iter(texts)).count(b" ") + 1 for _, texts, short in self.items if short})
        for members in classes.values():
            largest = max(len(self.items[i][1]) for i in members)
            k = largest - rule.need(largest) + 1
            for i in members:
                for key in hashes[i][:k].tolist():
                    keys[key].add(i)
        self.keys = np.array(sorted(keys), np.uint64)
        self.owners = [sorted(keys[k]) for k in self.keys.tolist()]
        # a bitmap on the low bits turns away nearly every shingle before the binary search
        self.bits = max(16, min(27, int(len(self.keys)).bit_length() + 6))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[(self.keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of ``hashes`` that are sketch keys."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64)
        likely = np.flatnonzero(self.map[(hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[likely]), len(self.keys) - 1)
        return likely[self.keys[at] == hashes[likely]]

    def verify(self, words: list[bytes], candidates: set[int]) -> Iterator[tuple[object, int, int]]:
        """Items really contained in a document: item id, shared and own distinct shingles."""
        held: dict[int, set[bytes]] = {}
        for i in sorted(candidates):
            item_id, texts, short = self.items[i]
            size = next(iter(texts)).count(b" ") + 1 if short else self.rule.words
            if size not in held:
                held[size] = set(shingles(words, size)) if len(words) >= size else set()
            shared = sum(t in held[size] for t in texts)
            if shared >= self.rule.need(len(texts)):
                yield item_id, shared, len(texts)


def _scan(block: ItemBlock):
    table, lower = bytetext.letters_table(), bytetext.lower_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = bytetext.Powers()
        for part in bytetext.slices(batches):
            data, offsets = bytetext.flat(part.column("text"))
            starts, ends = bytetext.runs(table[data], offsets)
            words = bytetext.span_hashes(lower[data], starts, ends, powers)
            doc_of = np.searchsorted(offsets, starts, "right") - 1
            found: dict[int, set[int]] = defaultdict(set)
            for size in [block.rule.words, *block.short_sizes]:
                hashes = bytetext.shingle_hashes(words, size)
                hits = block.probe(hashes)
                hits = hits[doc_of[hits] == doc_of[hits + size - 1]]
                at = np.searchsorted(block.keys, hashes[hits])
                for doc, key in set(zip(doc_of[hits].tolist(), at.tolist())):
                    found[doc].update(block.owners[key])
            if not found:
                continue
            ids, rows = part.column("doc_id"), []
            for doc in sorted(found):
                text = data[offsets[doc] : offsets[doc + 1]].tobytes()
                rows += [(ids[doc].as_py(), *hit) for hit in block.verify(normal_words(text), found[doc])]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], ids.type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                    ["doc_id", "item_id", "n_shared", "n_item"],
                )

    return run


def item_blocks(benchmark: DataFrame, rule: Containment) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded bytes: all of them, a block at a time."""
    items = benchmark.select("item_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text")).where("item_id is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // rule.block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        if rows:
            yield [(r.item_id, bytes(r.text)) for r in rows]


def contained_items(docs: DataFrame, benchmark: DataFrame, rule: Containment = Containment()) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` of every item a document contains.

    A document contains an item when at least ``threshold`` of the item's distinct
    shingles of ``words`` words occur in it.  Words are lower-case runs of letters
    and digits, so case, white space and ASCII punctuation do not matter.  An item
    of fewer words is one shingle of all its words; an item without words is never
    contained.  Null texts count as empty, rows with a null ``item_id`` are no
    items, repeated rows give repeated results, and further columns are ignored.

    The items travel with the tasks in blocks of ``block_bytes``, each measured
    before it is gathered; a larger benchmark takes more scans of the documents.
    Documents are never shuffled.
    """
    texts = bytetext.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, n_shared bigint, n_item bigint"
    out = None
    for rows in item_blocks(benchmark, rule):
        found = texts.mapInArrow(_scan(ItemBlock(rows, rule)), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rule: Containment = Containment()) -> DataFrame:
    """The documents that contain no benchmark item, all columns as they came."""
    leaked = contained_items(docs, benchmark, rule).select("doc_id").distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["doc_id"]), "left_anti")
