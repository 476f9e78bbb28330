"""Near-duplicate lines by a segment-partition edit-distance join.

If two lines are at most ``t`` edits apart and the shorter is cut into ``t + 1``
segments, the longer holds one of them unchanged, at a place that the lengths
and the segment's number narrow down.  Every line therefore enters the hash of
its own segments and of the substrings at which it could hold a segment of an
equally long or up to ``t`` characters shorter line.  Lines that meet are verified
by a banded bit-parallel edit distance.  Everything is DataFrame functions;
only hashes are shuffled until a pair has to be verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components, lookup
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class LineRule:
    """Edits allowed, shortest line they are allowed in, and the bucket size from which buckets are divided again.

    Shorter lines repeat only where they are equal: two edits would change too much of them.
    """

    edits: int = 2
    least_chars: int = 32
    pair_limit: int = 16


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def within_edits(long: Column, short: Column, edits: int) -> Column:
    """Whether two texts are at most ``edits`` edits apart; ``long`` is not the shorter one.

    The band of ``2 * edits + 1`` diagonals around the main one is a bit vector
    of vertical differences; each character of ``short`` moves it by a few word
    operations, as in Hyyrö's banded form of Myers' algorithm.
    """
    width = 2 * edits + 1
    ones = (1 << width) - 1
    bit = lambda x: x.bitwiseAND(F.lit(ones).cast("bigint"))
    inv = lambda x: bit(F.bitwise_not(x))
    num = lambda x: F.lit(x).cast("bigint")
    m, n = F.char_length(long), F.char_length(short)

    def over(chars: Column, other: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            here = F.get(other, i)
            match = None
            for k in range(width):
                one = F.when(F.get(chars, i - edits + k) == here, num(1 << k)).otherwise(num(0))
                match = one if match is None else match.bitwiseOR(one)
            vp, vn = acc["vp"], acc["vn"]

            def moved(x: Column) -> Column:
                d0 = bit((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)
                return _let(d0, lambda d: next_state(d))

            def next_state(d: Column) -> Column:
                hp, hn = vn.bitwiseOR(inv(d.bitwiseOR(vp))), d.bitwiseAND(vp)
                down = F.shiftright(d, 1)
                # first along the last diagonal of the band, then along the last row
                diagonal = acc["score"] + F.when(d.bitwiseAND(num(1 << width - 1)) == 0, 1).otherwise(0)
                at = F.call_function("shiftright", num(1 << width - 2), (i - (m - edits)).cast("int"))
                row = acc["score"] + F.when(hp.bitwiseAND(at) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(at) != 0, 1).otherwise(0)
                return F.struct(
                    hn.bitwiseOR(inv(down.bitwiseOR(hp))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    F.when(i < m - edits, diagonal).otherwise(row).cast("int").alias("score"),
                )

            return _let(match, moved)

        start = F.struct(num(ones & ~((1 << width - edits - 1) - 1)).alias("vp"), num(0).alias("vn"), F.lit(edits).alias("score"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["score"] <= edits)

    distance = _let(F.struct(F.split(long, "").alias("l"), F.split(short, "").alias("s")), lambda p: over(p["l"], p["s"]))
    return (m - n <= edits) & F.when(long == short, True).when(n <= edits, F.levenshtein(long, short) <= edits).otherwise(distance)


def unlike_middle(long: Column, short: Column) -> Column:
    """Both texts as ``l`` and ``s``, without equal blocks at their beginnings and then at their ends."""
    blocks = 16

    def without(l: Column, s: Column, from_end: bool) -> Column:
        size = F.floor(F.char_length(s) / blocks).cast("int")
        part = lambda x, k: F.substring(x, F.char_length(x) - size * (k + 1) + 1 if from_end else size * k + 1, size)
        differ = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: part(l, k) != part(s, k))
        equal = size * F.coalesce(F.get(differ, F.lit(0)), F.lit(blocks))
        if from_end:
            cut = lambda x, n: F.substring(x, F.lit(1), F.char_length(x) - n)
        else:
            cut = lambda x, n: F.substring(x, n + 1, F.char_length(x))
        return _let(equal, lambda n: F.struct(cut(l, n).alias("l"), cut(s, n).alias("s")))

    return _let(without(long, short, False), lambda p: without(p["l"], p["s"], True))


def may_be_within(long: Column, short: Column, edits: int) -> Column:
    """False only for texts that are more than ``edits`` edits apart.

    Of the pieces of the shorter text, each edit spoils one at most; the others stand in
    the longer one no further than ``edits`` characters from their own place.
    """
    parts = 2 * edits + 4
    n = F.char_length(short)
    size = F.floor(n / parts).cast("int")
    held = F.lit(0)
    for k in range(parts):
        start = size * k + 1
        own = size if k < parts - 1 else n - size * k
        around = F.substring(long, F.greatest(start - edits, F.lit(1)), own + 2 * edits)
        held = held + F.contains(around, F.substring(short, start, own)).cast("int")
    return held >= parts - edits


def lines_of(docs: DataFrame, rule: LineRule) -> DataFrame:
    """``(doc_id, line_no, line, h)`` of the lines that are not blank; ``h`` stands for the line."""
    split = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def _place() -> Column:
    """One number that orders all lines by document and line number."""
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("line_no")
    return place.cast("decimal(38,0)")


def _shifts(edits: int, less: int, k: int) -> tuple[int, int]:
    """How far segment ``k`` of a text ``less`` characters shorter can have moved: by the edits before it, or after it."""
    return max(-k, less - (edits - k)), min(k, less + (edits - k))


def _segment(m: Column, k: int | Column, parts: int) -> tuple[Column, Column]:
    """Start and size of segment ``k`` of a text of ``m`` characters; segments are even, the longer ones last."""
    longer, even = F.lit(k) - (parts - m % parts), ((m - m % parts) / parts).cast("int")
    return (even * k + F.greatest(longer, F.lit(0)) + 1).cast("int"), (even + F.when(longer >= 0, 1).otherwise(0)).cast("int")


def segment_keys(texts: DataFrame, edits: int) -> DataFrame:
    """``texts (h, rest)`` with one row for each key: ``(h, key)``.

    A key names the length of the shorter text, the segment and its content.  What a
    segment can cover is cut out once for all keys of the segment.
    """
    parts = edits + 1
    lit = lambda x: F.lit(x).cast("int")
    probes = [(less, k, shift) for less in range(parts) for k in range(parts) for low, high in [_shifts(edits, less, k)] for shift in range(low, high + 1)]
    sized = texts.where(F.char_length("rest") > edits).withColumn("n", F.char_length("rest"))
    froms, pieces = [], []
    for k in range(parts):
        own = [(*_segment(F.col("n") - less, k, parts), *_shifts(edits, less, k)) for less in range(parts)]
        low = F.greatest(F.lit(1), F.least(*(start + down for start, _, down, _ in own)))
        froms.append(low)
        pieces.append(F.substring(F.col("rest"), low, F.greatest(*(start + up + size for start, size, _, up in own)) - low))
    cut = sized.select("h", "n", F.array(*froms).alias("froms"), F.array(*pieces).alias("pieces"))
    rows = F.array(*(F.struct(lit(less).alias("less"), lit(k).alias("k"), lit(shift).alias("shift")) for less, k, shift in probes))
    each = cut.select("*", F.explode(rows).alias("p")).withColumn("m", F.col("n") - F.col("p.less")).where(F.col("m") > edits)
    start, size = _segment(F.col("m"), F.col("p.k"), parts)
    each = each.withColumn("start", start + F.col("p.shift")).withColumn("size", size)
    each = each.where((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n")))
    piece = F.substring(F.get("pieces", F.col("p.k")), F.col("start") - F.get("froms", F.col("p.k")) + 1, F.col("size"))
    return each.select("h", F.xxhash64("m", "p.k", piece).alias("key"))


BLOCKS = 8


def _masks(edits: int) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """Ways to be ``edits`` edits apart: ``(less, mask, number of blocks, stretches)``.

    All edits fall into some of the blocks of the shorter text, ``edits`` at most.  The
    stretches of blocks between those stand unchanged in the longer one, each moved by
    what the edits before it have inserted or deleted: ``(first block, end block, shift)``.
    """
    every = [dirty for count in range(1, edits + 1) for dirty in combinations(range(BLOCKS), count)]
    for mask, dirty in enumerate(every):
        borders = [-1, *dirty, BLOCKS]
        spans = [(a + 1, b) for a, b in zip(borders, borders[1:])]
        for less in range(edits + 1):
            for inner in product(range(-edits, edits + 1), repeat=len(dirty) - 1):
                shifts = [0, *inner, less]
                if sum(abs(b - a) for a, b in zip(shifts, shifts[1:])) > edits:
                    continue
                # an empty stretch stands nowhere: one shift stands for all
                if any(f == g and t < len(dirty) and shifts[t] != shifts[t - 1] for t, (f, g) in enumerate(spans) if t):
                    continue
                ends = [(BLOCKS, BLOCKS, less)] * (edits - len(dirty))
                yield less, mask, len(dirty), [*((f, g, shift) for (f, g), shift in zip(spans, shifts)), *ends]


def mask_keys(texts: DataFrame, edits: int) -> DataFrame:
    """``texts (h, rest, counts)`` with ``(h, counts, key, d0, d1, ...)`` for each way to leave up to ``edits`` blocks out.

    A key is all the text but those blocks, so the members of a bucket differ in them
    alone; the further columns stand for what is in their place.
    """
    lit = lambda x: F.lit(x).cast("int")
    rows = [
        F.struct(lit(less).alias("less"), lit(mask).alias("mask"), lit(count).alias("count"), F.array(*(F.struct(lit(f).alias("f"), lit(g).alias("g"), lit(s).alias("s")) for f, g, s in spans)).alias("spans"))
        for less, mask, count, spans in _masks(edits)
    ]
    each = texts.withColumn("n", F.char_length("rest")).select("*", F.explode(F.array(*rows)).alias("p")).select("*", (F.col("n") - F.col("p.less")).alias("m"))
    each = each.where("m >= 0").withColumn("even", F.expr(f"m div {BLOCKS}").cast("int"))
    at = lambda b: F.col("even") * b + F.greatest(b - (BLOCKS - F.col("m") % BLOCKS), F.lit(0))
    spans = [F.col("p.spans")[t] for t in range(edits + 1)]
    starts, ends = [at(x["f"]) + x["s"] for x in spans], [at(x["g"]) + x["s"] for x in spans]
    fits = (starts[0] >= 0) & (ends[-1] <= F.col("n"))
    for end, start in zip(ends, starts[1:]):
        fits = fits & (end <= start)
    each = each.where(fits)
    same = [F.substring(F.col("rest"), a + 1, b - a) for a, b in zip(starts, ends)]
    left = [F.xxhash64(F.substring(F.col("rest"), a + 1, b - a)) for a, b in zip(ends, starts[1:])]
    left = [F.when(F.col("p.count") > t, x).alias(f"d{t}") for t, x in enumerate(left)]
    return each.select("h", "counts", F.xxhash64("m", "p.mask", *same).alias("key"), *left)


#: Rows of hashes that are broadcast where they are counted and found to be no more; beyond, both sides are shuffled.
SMALL_ROWS = 200_000


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, which are stored and hold two numbers at most, marked for broadcast if few."""
    return F.broadcast(rows) if rows.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else rows


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows ``(key, h)`` of keys that more than one line has, with their number ``size`` and least hash ``low``, stored."""
    window = Window.partitionBy("key")
    both = keyed.withColumn("low", F.min("h").over(window)).withColumn("high", F.max("h").over(window))
    rows = both.where("low < high").drop("high").distinct()
    return cut_lineage(rows.withColumn("size", F.count(F.lit(1)).over(window)))


def _letter_kinds(text: Column) -> list[Column]:
    """How often letters and digits of six kinds occur."""
    kinds = ["".join(chr(c) for c in [*range(48, 58), *range(65, 91), *range(97, 123)] if c % 6 == k) for k in range(6)]
    return [(F.char_length(text) - F.char_length(F.translate(text, letters, ""))).cast("bigint") for letters in kinds]


def _letter_counts(text: Column) -> Column:
    """The counts of the six kinds in one number, ten bits each."""
    packed = F.lit(0).cast("bigint")
    for k, count in enumerate(_letter_kinds(text)):
        packed = packed.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(1023).cast("bigint")), 10 * k))
    return packed


def _cells(text: Column, edits: int) -> Column:
    """The cells of a grid over the first three counts that a text is in; two texts ``edits`` apart share one.

    A count within ``edits`` below the next cell is in that one too, where any greater count
    it has to meet may be.
    """
    width = edits + 1

    def spread(cells: Column, places: Column) -> Column:
        return F.flatten(F.transform(cells, lambda cell: F.transform(places, lambda place: F.xxhash64(cell, place))))

    cells = F.array(F.lit(42).cast("bigint"))
    for count in _letter_kinds(text)[:3]:
        cells = spread(cells, F.array_distinct(F.array(F.floor(count / width), F.floor((count + edits) / width))))
    return cells


def _counts_agree(edits: int) -> Column:
    """An edit moves the count of a kind by one at most."""
    agree = F.lit(True)
    for k in range(6):
        moved = F.shiftright("a_counts", 10 * k) - F.shiftright("b_counts", 10 * k) + edits
        agree = agree & (moved.bitwiseAND(F.lit(1023).cast("bigint")) <= 2 * edits)
    return agree


def _pairs(members: DataFrame, edits: int = 0, blocks: int = 0) -> DataFrame:
    """Pairs of lines that share a key, and whose letter counts allow ``edits`` where rows have them.

    With ``blocks``, rows are those of ``mask_keys``: lines are then paired only under the
    key that leaves out just the blocks in which they differ.
    """
    more = ["counts"] * bool(edits) + [f"d{t}" for t in range(blocks)]
    side = lambda s: members.select("key", F.col("h").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in more))
    close = F.col("a") < F.col("b")
    if edits:
        close = close & _counts_agree(edits)
    for t in range(blocks):
        close = close & (F.col(f"a_d{t}").isNull() | (F.col(f"a_d{t}") != F.col(f"b_d{t}")))
    return side("a").join(side("b"), "key").where(close).select("a", "b").distinct()


def _split(members: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows of keys of up to ``limit`` lines, and those of larger ones."""
    return members.where(F.col("size") <= limit), members.where(F.col("size") > limit)


def _within(pairs: DataFrame, level: DataFrame, edits: int) -> DataFrame:
    """Those of ``pairs (a, b)`` that are at most ``edits`` edits apart, stored; ``a`` may have any number of partners."""
    side = lambda s: level.select(F.col("h").alias(s), F.col("rest").alias(f"{s}_rest"), F.col("counts").alias(f"{s}_counts"))
    both = lookup(pairs, side("a"), "a", "b").join(side("b"), "b").where(_counts_agree(edits))
    turn = F.char_length("a_rest") >= F.char_length("b_rest")
    long, short = (F.when(turn, F.col(x)).otherwise(F.col(y)) for x, y in (("a_rest", "b_rest"), ("b_rest", "a_rest")))
    both = both.select("a", "b", long.alias("long"), short.alias("short")).where(may_be_within(F.col("long"), F.col("short"), edits))
    both = cut_lineage(both.select("a", "b", unlike_middle(F.col("long"), F.col("short")).alias("p")))
    return cut_lineage(both.where(within_edits(F.col("p.l"), F.col("p.s"), edits)).select("a", "b"))


def _apart(many: DataFrame, stars: DataFrame) -> DataFrame:
    """The rows ``(key, h)`` of those buckets that the links ``stars`` do not join wholly, stored."""
    labels = connected_components(stars).select(F.col("node").alias("h"), F.col("component").alias("c"))
    named = many.select("key", "h").join(labels, "h", "left").withColumn("c", F.coalesce("c", "h"))
    window = Window.partitionBy("key")
    ends = named.withColumn("first", F.min("c").over(window)).withColumn("last", F.max("c").over(window))
    return cut_lineage(ends.where("first < last").select("key", "h"))


def candidates(lines: DataFrame, rule: LineRule) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of line hashes that share a segment where they may, as far as classes need them, and their lines.

    The lines are ``(h, line, counts, node)``, stored; ``node`` names a line by its first place.
    The members of a bucket of up to ``pair_limit`` lines are paired.  In a larger one all are
    compared with one of them; where that joins them all, no further pair is needed.  Else it is
    divided by how often letters occur, which edits change little.  Two lines that are
    still among many are both keyed anew, by all their text but as many of its
    blocks as there may be edits, and paired where they meet then.
    """
    edits, limit = rule.edits, rule.pair_limit
    # copies of a line would meet under each of its keys, all in one group
    shared = _shared(segment_keys(lines.select("h", F.col("line").alias("rest")).distinct(), edits))
    named = _named_lines(lines, cut_lineage(shared.select("h").distinct()))
    few, many = _split(shared, limit)
    found = _pairs(few)
    hot = cut_lineage(many.select("h").distinct())
    if hot.isEmpty():
        return found, named
    level = named.join(_small(hot), "h").select("h", F.col("line").alias("rest"), "counts")
    level = cut_lineage(level.withColumn("cells", _cells(F.col("rest"), edits)))
    stars = _within(many.where("h != low").select(F.col("low").alias("a"), F.col("h").alias("b")).distinct(), level, edits)
    found, many = found.union(stars), _apart(many, stars)
    if many.isEmpty():
        return found.distinct(), named
    divided = many.join(level.select("h", "counts", "cells"), "h").select("h", "counts", "key", F.explode("cells").alias("cell"))
    few, many = _split(_shared(divided.select("h", "counts", F.xxhash64("key", "cell").alias("key"))), limit)
    found = found.union(_pairs(few, edits))
    crowded = cut_lineage(many.select("h").distinct())
    masked = mask_keys(level.join(_small(crowded), "h").select("h", "rest", "counts"), edits)
    return found.union(_pairs(_shared(masked), edits, edits)).distinct(), named


def _named_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h, line, counts, node)`` of the distinct lines whose hashes are ``wanted``, stored."""
    first = lines.join(_small(wanted), "h").groupBy("h", "line").agg(F.min(_place()).alias("place"))
    node = F.struct("place", "h", _digest().alias("digest")).alias("node")
    return cut_lineage(first.select("h", "line", _letter_counts(F.col("line")).alias("counts"), node))


def _digest() -> Column:
    """128 bits of the line's SHA-256, which tell equal lines."""
    return F.substring(F.unhex(F.sha2("line", 256)), 1, 16)


def line_classes(lines: DataFrame, rule: LineRule) -> DataFrame:
    """``(h, digest, first_place)`` of the distinct lines that occur again or are linked to another line.

    A class holds all lines linked by at most ``edits`` edits, directly or over
    others; ``first_place`` is where its first line stands.
    """
    marked = lines.select("h", _digest().alias("digest"), _place().alias("place"))
    repeated = marked.groupBy("h", "digest").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    repeated = cut_lineage(repeated.where("n > 1").select("h", "digest", "place"))
    near, texts = candidates(lines.where(F.char_length("line") >= rule.least_chars), rule)
    near = cut_lineage(near)
    side = lambda s: texts.select(F.col("h").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("line", "counts", "node")))
    pairs = near.join(side("a"), "a").join(side("b"), "b").where(_counts_agree(rule.edits))
    turn = F.char_length("a_line") >= F.char_length("b_line")
    long, short = F.when(turn, F.col("a_line")).otherwise(F.col("b_line")), F.when(turn, F.col("b_line")).otherwise(F.col("a_line"))
    pairs = pairs.withColumn("long", long).withColumn("short", short).where(may_be_within(F.col("long"), F.col("short"), rule.edits))
    pairs = cut_lineage(pairs.select("a_node", "b_node", unlike_middle(F.col("long"), F.col("short")).alias("p")))
    linked = pairs.where(within_edits(F.col("p.l"), F.col("p.s"), rule.edits)).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    classes = connected_components(linked)
    first = classes.select(F.col("node.h").alias("h"), F.col("node.digest").alias("digest"), F.col("component.place").alias("near_place"))
    joined = repeated.join(first, ["h", "digest"], "full")
    return joined.select("h", "digest", F.coalesce("near_place", "place").alias("first_place"))


def repeated_lines(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """``(doc_id, line_no)`` of every line that repeats an earlier line, wholly or within ``edits`` edits."""
    lines = lines_of(docs, rule)
    classes = line_classes(lines, rule)
    seen = lines.select("doc_id", "line_no", "h", _digest().alias("digest"))
    return seen.join(classes, ["h", "digest"]).where(_place() > F.col("first_place")).select("doc_id", "line_no").distinct()


def dedup_lines(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines`` and ``n_dropped`` added.

    A line goes when an earlier line, by ``doc_id`` and line number, belongs to its
    class; the first line of each class stays, and so do blank lines.  Lines of less than
    ``least_chars`` characters have only equal ones in theirs.  Rows with a null id or text stay as they are
    (``n_lines`` 0 for null texts); rows repeated under one id count as one
    document.  Other columns come through unchanged.
    """
    numbers = repeated_lines(docs.select("doc_id", "text"), rule).groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("line_no").alias("numbers"))
    joined = docs.join(numbers, docs["doc_id"] == numbers["of"], "left")
    whole, gone = docs["text"], numbers["numbers"]

    def without(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.array_join(F.transform(kept, lambda k: F.get(parts, k)), "\n")

    text = F.when(gone.isNull() | whole.isNull(), whole).otherwise(_let(F.split(whole, "\n"), without))
    n_lines = F.when(whole.isNull(), 0).otherwise(F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    dropped = F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("bigint")
    return joined.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns), n_lines.alias("n_lines"), dropped.alias("n_dropped"))
