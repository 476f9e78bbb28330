"""Near-duplicates of exact Jaccard similarity, with b-bit MinHash between the bands and the proof.

A document is the set of its distinct word shingles.  ``bands * rows`` minima of permuted
hashes give one key a band, and documents that share a key are candidates: at
similarity 0.85, 32 bands of 5 miss a pair once in a hundred million.  Of every minimum
only the lowest two bits are retained, packed into 64-bit words.  Two unequal minima
agree in them once in four, so the share ``p`` of agreeing fields, counted with
``bit_count``, estimates the similarity as ``(p - 1/4) / (3/4)``.  Candidates whose
estimate lies more than ``deviations`` standard deviations below the threshold go; the
others are compared on their whole sets.

Documents with equal sets are folded to one first.  In a large bucket leaders are compared
with all of it, components are taken, and only what is outside the component that prevails
in its bucket is looked at again, by how it differs from a leader.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext
from tidemark.llm.components import connected_components, lookup
from tidemark.session import cut_lineage

BITS = 2
_FIELDS = 64 // BITS


@dataclass(frozen=True)
class BBitRule:
    """Shingle length, least similarity in percent, bands and their minima, and how buckets are compared.

    ``pair_limit``: buckets of so many sets are compared pair by pair.  ``leaders``: how many
    leaders a larger one gets.  ``deviations``: slack of the estimate.
    """

    words: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 5
    pair_limit: int = 16
    leaders: int = 2
    deviations: float = 6.0

    @property
    def packed_words(self) -> int:
        return -(-self.bands * self.rows // _FIELDS)

    @property
    def least_matches(self) -> int:
        """Agreeing fields below which a pair cannot reach the threshold, but for the stated deviations."""
        minima, chance = self.bands * self.rows, 2.0**-BITS
        p = chance + (1 - chance) * self.percent / 100
        return math.floor(minima * p - self.deviations * math.sqrt(minima * p * (1 - p)))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytetext.lower_table()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, powers: bytetext.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and where each text's begin.

    Words are what ASCII white space separates, A-Z lower-cased; fewer than ``size`` words make one shingle.
    """
    starts, ends = bytetext.runs(~_SPACE[data], offsets)
    words = bytetext.span_hashes(_LOWER[data], starts, ends, powers)
    edges = np.searchsorted(starts, offsets)
    hashes = bytetext.shingle_hashes(words, size)
    sets = []
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        own = hashes[a : b - size + 1] if b - a >= size else bytetext.shingle_hashes(words[a:b], b - a) if b > a else words[:0]
        sets.append(np.unique(own))
    return np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def minima(hashes: np.ndarray, edges: np.ndarray, count: int) -> np.ndarray:
    """``count`` permuted minima of each non-empty set, one row a set."""
    seeds = bytetext.mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    begins = edges[:-1][np.diff(edges) > 0]
    out = np.zeros((len(begins), count), np.uint64)
    for k in range(count):
        out[:, k] = np.minimum.reduceat((hashes ^ seeds[k]) * (seeds[count + k] | np.uint64(1)), begins)
    return bytetext.mix(out)


def band_keys(values: np.ndarray, rule: BBitRule) -> np.ndarray:
    keys = np.zeros((len(values), rule.bands), np.uint64) + np.arange(rule.bands, dtype=np.uint64)
    for k in range(rule.rows):
        keys = bytetext.mix(keys ^ values[:, k :: rule.rows])
    return keys


def packed(values: np.ndarray) -> np.ndarray:
    """The lowest bits of all minima of a set, 32 fields to a word; absent fields are zero."""
    low = (values & np.uint64((1 << BITS) - 1)).astype(np.uint64)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % _FIELDS)))
    low = low.reshape(len(low), low.shape[1] // _FIELDS, _FIELDS)
    return np.bitwise_or.reduce(low << (np.arange(_FIELDS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def matches(a: Column, b: Column, rule: BBitRule) -> Column:
    """How many fields of two packed signatures (arrays of words) agree."""
    total = F.lit(rule.bands * rule.rows)
    for k in range(rule.packed_words):
        differ = a[k].bitwiseXOR(b[k])
        total = total - F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return total


def estimate(matching: Column, rule: BBitRule) -> Column:
    """Similarity estimated from agreeing fields, corrected for those that agree by chance."""
    chance = 2.0**-BITS
    return (matching / (rule.bands * rule.rows) - chance) / (1 - chance)


def sets_of(docs: DataFrame, rule: BBitRule, sketch: bool) -> DataFrame:
    """``(doc_id, h, n, items, bits)`` of every row: ``items`` are band keys, or the set where ``sketch`` is off."""
    texts = bytetext.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(bytetext.signed(values.ravel())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = bytetext.Powers()
        for part in bytetext.slices(batches):
            hashes, edges = shingle_sets(*bytetext.flat(part.column("text")), rule.words, powers)
            n = np.diff(edges)
            h = pa.array([xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(edges.tolist(), edges[1:].tolist())], pa.binary())
            if sketch:
                values = minima(hashes, edges, rule.bands * rule.rows) if len(hashes) else np.zeros((0, rule.bands * rule.rows), np.uint64)
                items, bits = lists(band_keys(values, rule), (n > 0) * rule.bands), lists(packed(values), (n > 0) * rule.packed_words)
            else:
                items, bits = lists(hashes, n), lists(hashes[:0], n * 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), h, pa.array(n, pa.int64()), items, bits], ["doc_id", "h", "n", "items", "bits"])

    return texts.mapInArrow(run, f"doc_id {kind}, h binary, n bigint, items array<bigint>, bits array<bigint>")


def _meeting(left: DataFrame, right: DataFrame, close: Column) -> DataFrame:
    """Pairs ``(a, b)`` of rows ``(key, h, ...)`` with one key, once each."""
    side = lambda rows, s: rows.select("key", F.col("h").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in rows.columns if c not in ("key", "h")])
    return side(left, "a").join(side(right, "b"), "key").where(close).select("a", "b").distinct()


def _likely(pairs: DataFrame, info: DataFrame, rule: BBitRule) -> DataFrame:
    """Those of ``pairs (a, b)`` that can be similar by ``info (h, n, m, bits)``, stored.

    ``m`` bounds what a set shares with any other, so that no pair is lost to it; signatures decide the rest.
    """
    side = lambda s: info.select(F.col("h").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "m", "bits")])
    common = F.least("a_m", "b_m")
    able = common * 100 >= (F.col("a_n") + F.col("b_n") - common) * rule.percent
    near = matches(F.col("a_bits"), F.col("b_bits"), rule) >= rule.least_matches
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return cut_lineage(both.where(able & near).select("a", "b"))


def _proven(pairs: DataFrame, sets: DataFrame, rule: BBitRule, hub: bool) -> DataFrame:
    """Those of ``pairs (a, b)`` whose whole sets have the similarity; with ``hub``, ``a`` may have any number of partners."""
    side = lambda s: sets.select(F.col("h").alias(s), F.col("items").alias(f"{s}_items"))
    if hub:
        # the set of a hub goes to 64 tasks, each of which has its share of the partners
        salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(64)))
        hubs = salted.select("a", "_salt").distinct().join(side("a"), "a")
        both = salted.join(side("b"), "b").join(hubs, ["a", "_salt"])
    else:
        both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_items", "b_items"))
    return both.where(shared * 100 >= (F.size("a_items") + F.size("b_items") - shared) * rule.percent).select("a", "b")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(h, c)``: labels with new links between their components; sets that nothing joins have no row."""
    if labels is None:
        found = connected_components(links).select(F.col("node").alias("h"), F.col("component").alias("c"))
        return cut_lineage(found.union(found.select(F.col("c").alias("h"), "c").distinct()))
    if links.isEmpty():
        return labels
    old = lambda s: labels.select(F.col("h").alias(s), F.col("c").alias(f"{s}_c"))
    raised = links.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    joined = connected_components(raised).select(F.col("node").alias("c"), F.col("component").alias("to"))
    # sets that had no label yet
    fresh = links.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(labels, "h", "left_anti").select("h", F.col("h").alias("c"))
    return cut_lineage(labels.union(fresh).join(joined, "c", "left").select("h", F.coalesce("to", "c").alias("c")))


def _sharing(info: DataFrame, sets: DataFrame, rule: BBitRule) -> DataFrame:
    """``(h, n, m, bits)`` of the sets of ``info`` that can have a partner among them, with ``m`` counted.

    ``m`` is how many of a set's shingles any other has.  One whose own shingles alone are
    too many is similar to nothing, and what it leaves is counted once more without it.
    """
    marks = [F.xxhash64("h", F.lit(k)).alias(f"h{k}") for k in range(2)]
    alive = info.select("h", "n")
    for _ in range(2):
        items = sets.join(alive.select("h"), "h", "left_semi").select(*marks, F.explode("items").alias("item"))
        # a shingle of one set names it, so that nothing has to be joined back to shingles
        alone = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("h0").alias("h0"), F.min("h1").alias("h1")).where("n = 1")
        own = alone.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("own"))
        counted = alive.select("h", "n", *marks).join(own, ["h0", "h1"], "left").withColumn("m", F.col("n") - F.coalesce("own", F.lit(0)))
        alive = cut_lineage(counted.where(F.col("m") * 100 >= F.col("n") * rule.percent).select("h", "n", "m"))
    return cut_lineage(info.drop("m", "n").join(alive, "h"))


def _with_labels(hot: DataFrame, labels: DataFrame) -> DataFrame:
    return cut_lineage(hot.join(labels, "h", "left").withColumn("c", F.coalesce("c", "h")))


def _apart(hot: DataFrame) -> DataFrame:
    """The rows of large buckets outside the component that prevails there."""
    most = hot.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("c", F.struct("size", "c")).alias("main"))
    return hot.join(most, "key").where("c != main").drop("main")


def _leading(rows: DataFrame, leaders: int) -> DataFrame:
    """``(key, h)`` of up to ``leaders`` sets of each bucket: of each part by hash, the one in most large buckets."""
    salt = F.pmod(F.xxhash64("h"), F.lit(leaders)).alias("salt")
    first = rows.groupBy("key", salt).agg(F.min(F.struct("order", "h")).alias("first"))
    return first.select("key", "first.h")


def components(docs: DataFrame, groups: DataFrame, rule: BBitRule, alike: DataFrame | None = None) -> DataFrame:
    """``(h, c)`` of all linked sets of ``groups (h, n, first_id, items, bits)``; ``c`` is one of the component's sets.

    Keys are matched without anything else; sizes and signatures join the pairs that share one.
    ``alike (a, b)``: pairs, stored, that are compared besides, of which ``a`` may have any number.
    """
    info = groups.select("h", "n", F.col("n").alias("m"), "bits")
    keyed = groups.select("h", F.explode("items").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut_lineage(keyed.join(sizes, "key"))
    cold, hot = shared.where(F.col("size") <= rule.pair_limit).drop("size"), shared.where(F.col("size") > rule.pair_limit).drop("size")
    pairs = _likely(_meeting(cold, cold, F.col("a") < F.col("b")), info, rule)
    # sets that are in many large buckets lead
    hot = cut_lineage(hot.join(hot.groupBy("h").agg((-F.count(F.lit(1))).alias("order")), "h"))
    stars = _likely(_meeting(_leading(hot, rule.leaders), hot.select("key", "h"), F.col("a") != F.col("b")), info, rule)
    hubs = stars if alike is None else stars.union(alike)
    wanted = pairs.union(hubs).select(F.explode(F.array("a", "b")).alias("h")).union(hot.select("h")).distinct()
    sets = _wanted_sets(docs, groups, wanted, rule)
    labels = _merged(None, cut_lineage(_proven(pairs, sets, rule, hub=False).union(_proven(hubs, sets, rule, hub=True))))
    rest = _apart(_with_labels(hot, labels))
    if rest.isEmpty():
        return labels
    info = _sharing(info.join(hot.select("h").distinct(), "h", "left_semi"), sets, rule)
    hot = _with_labels(hot.join(info.select("h"), "h", "left_semi"), labels)
    left = _likely(_by_differences(hot, info, sets, rule), info, rule)
    return _merged(labels, cut_lineage(_proven(left, sets, rule, hub=True)))


#: Classes of numbers of differences: the first has 8 and each about an eighth more than the one before.
_CLASS_STEP, _CLASS_RATIO = 8.0, 1.125


def _class_of(d: Column) -> Column:
    return F.floor(F.log(F.greatest(d, F.lit(0)) / _CLASS_STEP + 1) / math.log(_CLASS_RATIO)).cast("int")


def _least_of(number: Column) -> Column:
    return F.floor((F.pow(F.lit(_CLASS_RATIO), number) - 1) * _CLASS_STEP - 1e-6)


def _by_differences(hot: DataFrame, info: DataFrame, sets: DataFrame, rule: BBitRule) -> DataFrame:
    """Pairs ``(a, b)`` of rows ``hot (key, h, order, c)`` that may be similar though their buckets are large.

    ``a`` is outside the component that prevails in its bucket.

    Copies of one original agree in nearly everything, so what tells them apart is how they
    differ from a leader: ``D(x)``, the shingles only one of both has.  ``x`` and ``y`` are
    similar when their sets differ in at most ``slack`` shingles, and they differ where exactly one of
    ``D(x)`` and ``D(y)`` has one, so these have to share ``(|D(x)| + |D(y)| - slack) / 2``.
    In one order of all shingles (the rarest first) two sets that
    share ``t`` elements share one of the first ``|D| - t + 1`` of each; only those meet.
    Sizes of ``D`` are told apart by classes, since ``t`` depends on both.
    """
    # two sets of a bucket's main component need no proof, so buckets that hold nothing else are done with
    apart = cut_lineage(_apart(hot).select("key", "h"))
    hot = hot.join(apart.select("key").distinct(), "key", "left_semi")
    # leaders of one component share the first of them, which need not be in the bucket: a set then has few leaders, not one a band
    first = hot.groupBy("key").agg(F.min(F.struct("order", "h", "c")).alias("first")).select("key", "first.*")
    shared = first.groupBy("c").agg(F.min(F.struct("order", "h")).alias("shared"))
    leader = first.join(shared, "c").select("key", F.col("shared.h").alias("leader"))
    asking = apart.select("h").distinct().withColumn("asks", F.lit(True))
    members = hot.join(leader, "key").select("leader", "h", "c").distinct().join(asking, "h", "left").join(info.select("h", "n"), "h")
    items = lambda s: sets.select(F.col("h").alias(s), F.col("items").alias(f"{s}_items"))
    both = lookup(cut_lineage(members), items("leader"), "leader", "h").join(items("h"), "h")
    both = both.withColumn("d", F.array_union(F.array_except("h_items", "leader_items"), F.array_except("leader_items", "h_items"))).drop("h_items", "leader_items")
    both = cut_lineage(both.withColumn("size", F.size("d")))
    # places that agree by chance are only taken for more frequent ones, by all sets alike
    spread = both.select("leader", "h", F.explode("d").alias("item")).withColumn("place", F.xxhash64("leader", "item"))
    often = spread.groupBy("place").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ordered = lookup(spread, often, "place", "h").groupBy("leader", "h").agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("o"))
    # an element that no other set differs in meets nobody; being the rarest, such are the first
    ordered = ordered.select("leader", "h", F.col("o.item").alias("o"))
    none = F.array().cast("array<bigint>")
    both = cut_lineage(both.drop("d").join(ordered, ["leader", "h"], "left").withColumn("o", F.coalesce("o", none)))
    # two similar sets have at most n + n * 100 / percent shingles, of which they differ in a share
    slack = F.col("n") * ((1 + 100 / rule.percent) * (100 - rule.percent) / (100 + rule.percent)) + 1e-6
    size = F.col("size")
    both = both.withColumn("slack", slack)
    slack = F.col("slack")
    both = both.withColumn("own", _class_of(size)).withColumnRenamed("leader", "star")
    # only classes that hold a set of another component, one of the two asking, are worth rows; a leader has few classes
    held = both.groupBy("star", "own").agg(F.max("asks").alias("asked"), F.min("c").alias("low"), F.max("c").alias("high"))
    held = held.groupBy("star").agg(F.collect_list(F.struct("own", "asked", "low", "high")).alias("held"))
    useful = lambda k: k["own"].between(_class_of(size - F.ceil(slack)), _class_of(size + F.ceil(slack))) & (F.col("asks") | k["asked"]) & ((k["low"] != F.col("c")) | (k["high"] != F.col("c")))
    others = F.transform(F.filter("held", useful), lambda k: k["own"])
    rows = lookup(both, held, "star", "h").select("star", "h", "c", "asks", "o", "size", "slack", "own", F.explode(others).alias("other"))
    share = F.ceil((size + _least_of(F.col("other")) - slack) / 2)
    shown = size - share + 1 - (size - F.size("o"))
    met = F.when(share < 1, F.concat(F.array(F.lit(0).cast("bigint")), F.col("o"))).otherwise(F.slice("o", F.lit(1), F.greatest(shown, F.lit(0)).cast("int")))
    rows = rows.withColumn("item", F.explode(met))
    # keys that agree by chance only make a pair more to be compared
    key = F.xxhash64("star", "item", F.least("own", "other"), F.greatest("own", "other"))
    rows = cut_lineage(rows.select(key.alias("key"), "own", "other", "h", "c", "asks"))
    mirrored = (F.col("a_own") == F.col("b_other")) & (F.col("a_other") == F.col("b_own")) & (F.col("a_c") != F.col("b_c"))
    return _meeting(rows.where("asks").drop("asks"), rows.drop("asks"), mirrored)


def _wanted_sets(docs: DataFrame, groups: DataFrame, wanted: DataFrame, rule: BBitRule) -> DataFrame:
    """``(h, items)`` of the sets in ``wanted``, made again from one text each; stored."""
    named = cut_lineage(groups.select("h", "first_id").join(wanted, "h", "left_semi"))
    texts = docs.join(named.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    made = cut_lineage(sets_of(texts, rule, sketch=False).select("h", "items").join(named.select("h"), "h", "left_semi"))
    # an id that is repeated gives its sets again
    repeated = made.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    if repeated.isEmpty():
        return made
    once = made.join(repeated, "h", "left_semi").groupBy("h").agg(F.first("items").alias("items"))
    return cut_lineage(made.join(repeated, "h", "left_anti").union(once))


def near_duplicates(docs: DataFrame, rule: BBitRule = BBitRule()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs``.

    Words are what ASCII white space separates, A-Z lower-cased; fewer than ``words`` make
    one shingle.  ``component_id`` is the smallest ``doc_id`` reachable over pairs of at least
    ``percent`` hundredths of Jaccard similarity, itself included; ``kept`` marks it.
    Null texts count as empty; documents without words are linked with nothing.
    Repeated rows give repeated results; rows with a null id have a null component and
    are kept; other columns are ignored.
    """
    sketches = cut_lineage(sets_of(docs, rule, sketch=True))
    named = sketches.where("doc_id is not null and n > 0")
    groups = named.groupBy("h").agg(F.min("n").alias("n"), F.min("doc_id").alias("first_id"), F.first("items").alias("items"), F.first("bits").alias("bits"))
    groups = cut_lineage(groups)
    labels = components(docs.select("doc_id", "text"), groups, rule)
    placed = groups.select("h", "first_id").join(labels, "h", "left").withColumn("c", F.coalesce("c", "h"))
    least = placed.groupBy("c").agg(F.min("first_id").alias("component_id"))
    ids = lookup(cut_lineage(placed), least, "c", "h").select("h", "component_id")
    found = lookup(sketches.select("doc_id", "n", "h"), ids, "h", "doc_id", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, rule: BBitRule = BBitRule()) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, once for each id; rows with a null id all stay."""
    kept = near_duplicates(docs.select("doc_id", "text"), rule).where("kept and doc_id is not null").select("doc_id").distinct()
    order = F.struct(F.coalesce("text", F.lit("")))
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    one = named.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return one.unionByName(docs.where("doc_id is null"))
