"""The prefix trie of conversations that borrow the beginning of another one.

A conversation is rebuilt from the head of its base and from its own turns behind its
own head.  Neither the rebuilt turns nor their prefixes are ever formed: a sequence of
turns is an element of a monoid, ``(length, words, products)``, whose products are
polynomial hashes modulo four primes, and

    (m, u, P) * (n, v, Q) = (m + n, u + v, P + B ** m * Q).

Every turn keeps the element of its own conversation up to it, which is a scan of the
monoid.  The element of a rebuilt prefix is the base head's times the own suffix's, and
the suffix is what the own prefix leaves when its head is divided out, so each rebuilt
turn costs one row and a few multiplications.

Rows with equal depth and element make a node.  That equal elements are equal
sequences is proven, not assumed: all members of a node have to hold the same turn, by
the SHA-256 of role and text stored with each turn, under the same parent; by induction over
the depth they are then equal throughout.  Should the proof fail, other hashes are tried.

What a node reports of its subtree needs no walk over levels.  Prefix groups only shrink
on the way down, so a conversation that is the smallest member of a node is that of all
nodes below on its own path: ``top`` is the depth from which it is.  A node's children, leaves
and the words counted once below it are then sums over its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

#: Moduli just below 2 ** 31, so that products and sums of four thousand million terms fit 64 bits.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003161, 1300135927, 1700219633, 1900327459)


@dataclass(frozen=True)
class TrieRule:
    """Which conversation lends its head, how long heads are, and how long conversations are cut into shards.

    ``every``: conversation ``c`` borrows from ``c - c % every``; ``heads``: it borrows
    ``crc32(c) % heads`` turns.  ``span`` shapes the plan only: turns in one shard.
    ``piece``: ids joined into one string before the hash of a node's ends reads them.
    """

    every: int = 20
    heads: int = 4
    span: int = 256
    piece: int = 65536


def _products(name: str = "p") -> list[str]:
    return [f"{name}{k}" for k in range(len(PRIMES))]


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in _products("b")]))
def _powers(exponents: pd.Series) -> pd.DataFrame:
    """Each base to the exponent, from 0, modulo its prime."""
    left = exponents.to_numpy(np.int64)
    squares = list(BASES)
    out = np.ones((len(PRIMES), len(left)), np.int64)
    while left.any():
        for k, prime in enumerate(PRIMES):
            out[k] = np.where(left & 1, out[k] * squares[k] % prime, out[k])
            squares[k] = squares[k] * squares[k] % prime
        left = left >> 1
    return pd.DataFrame(dict(zip(_products("b"), out)))


def _inverse_power(k: int, steps: Column, most: int) -> Column:
    """``BASES[k] ** -steps`` for ``steps`` in 0..most."""
    inverse = pow(BASES[k], -1, PRIMES[k])
    out = F.lit(1).cast("bigint")
    for n in range(1, most + 1):
        out = F.when(steps == n, F.lit(pow(inverse, n, PRIMES[k]))).otherwise(out)
    return out


def scan_turns(turns: DataFrame, rule: TrieRule = TrieRule(), salt: int = 0) -> DataFrame:
    """``(conv_id, pos, own, words, p0..p3, q0..q3, digest)``: the element of every conversation up to each of its turns.

    Turns are in the order of ``turn`` (null first), then role, then digest; rows without a
    ``conv_id`` belong to no conversation.  ``words`` and ``p`` include the turn, ``q`` does not;
    ``own`` are the words of the turn alone.  A conversation is scanned shard by shard, shards in parallel.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    place = F.col("turn").cast("bigint")
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        place.alias("turn"),
        F.coalesce(F.floor(place / rule.span).cast("bigint"), F.lit(-(1 << 62))).alias("shard"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("own"),
    )
    inside = Window.partitionBy("conv_id", "shard").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("i", F.row_number().over(inside).cast("bigint")).withColumn("b", _powers("i"))
    term = lambda k: F.pmod(F.xxhash64("digest", F.lit(salt), F.lit(k)), F.lit(PRIMES[k])) * F.col(f"b.b{k}") % PRIMES[k]
    rows = rows.withColumns({f"t{k}": term(k) for k in range(len(PRIMES))})
    rows = rows.withColumns({"words": F.sum("own").over(upto), **{f"s{k}": F.sum(f"t{k}").over(upto) for k in range(len(PRIMES))}})
    rows = cut_lineage(rows.select("conv_id", "shard", "i", "own", "words", "digest", *_products("s"), *_products("t")))
    # sums of terms only grow, so the element of a whole shard is the greatest one
    whole = rows.groupBy("conv_id", "shard").agg(*[F.max(c).alias(f"{c}_all") for c in ("i", "words", *_products("s"))])
    earlier = Window.partitionBy("conv_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumns({"before": F.coalesce(F.sum("i_all").over(earlier), F.lit(0)), "words_before": F.coalesce(F.sum("words_all").over(earlier), F.lit(0))})
    whole = whole.withColumn("b", _powers("before"))
    moved = {f"c{k}": F.coalesce(F.sum(F.col(f"s{k}_all") % PRIMES[k] * F.col(f"b.b{k}") % PRIMES[k]).over(earlier), F.lit(0)) for k in range(len(PRIMES))}
    carried = whole.withColumns(moved).select("conv_id", "shard", "before", "words_before", "b", *_products("c"))
    joined = rows.join(carried, ["conv_id", "shard"])
    product = lambda k, upto: (F.col(f"c{k}") + F.col(f"b.b{k}") * (upto % PRIMES[k]) % PRIMES[k]) % PRIMES[k]
    return joined.select(
        "conv_id",
        (F.col("before") + F.col("i")).alias("pos"),
        "own",
        (F.col("words_before") + F.col("words")).alias("words"),
        *[product(k, F.col(f"s{k}")).alias(f"p{k}") for k in range(len(PRIMES))],
        *[product(k, F.col(f"s{k}") - F.col(f"t{k}")).alias(f"q{k}") for k in range(len(PRIMES))],
        "digest",
    )


def _conversations(scanned: DataFrame, rule: TrieRule) -> DataFrame:
    """One row a conversation: its length, where its suffix goes, and what to add to its own elements."""
    most = rule.heads - 1
    at = lambda value, k: F.max(F.when(F.col("pos") == k, F.col(value)))
    points = [at(value, k).alias(f"{value}_{k}") for k in range(1, most + 1) for value in ("words", *_products())]
    summed = scanned.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max("words").alias("words"), *points)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % rule.heads
    summed = cut_lineage(summed.withColumns({"base": F.col("conv_id") - F.col("conv_id") % rule.every, "head": head}))

    def upto(length: Column, value: str, prefix: str = "") -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(1, most + 1):
            out = F.when(length == k, F.col(f"{prefix}{value}_{k}")).otherwise(out)
        return out

    lent = ["n", *[f"{value}_{k}" for k in range(1, most + 1) for value in ("words", *_products())]]
    bases = summed.where(F.col("conv_id") % rule.every == 0).select(F.col("conv_id").alias("base"), *[F.col(c).alias(f"base_{c}") for c in lent])
    both = summed.join(bases, "base", "left").withColumns({"borrowed": F.least("head", F.coalesce("base_n", F.lit(0))), "cut": F.least("head", "n")})
    back = F.col("head") - F.col("borrowed")
    shifts = {f"f{k}": _inverse_power(k, back, most) for k in range(len(PRIMES))}
    adds = {f"a{k}": (upto(F.col("borrowed"), f"p{k}", "base_") + PRIMES[k] - F.col(f"f{k}") * upto(F.col("cut"), f"p{k}") % PRIMES[k]) % PRIMES[k] for k in range(len(PRIMES))}
    words = upto(F.col("borrowed"), "words", "base_") - upto(F.col("cut"), "words")
    length = F.col("borrowed") + F.greatest(F.col("n") - F.col("head"), F.lit(0))
    total = F.when(F.col("n") > F.col("head"), F.col("words") + words).otherwise(upto(F.col("borrowed"), "words", "base_"))
    both = both.withColumns(shifts).withColumns(adds)
    return both.select(
        "conv_id", "base", "n", "head", "borrowed", back.alias("back"), length.alias("length"), words.alias("add_words"), total.alias("total"), *_products("f"), *_products("a")
    )


def _packed(values: list[Column], high: str, low: str) -> list[Column]:
    a, b, c, d = values
    return [F.shiftleft(a, 31).bitwiseOR(b).alias(high), F.shiftleft(c, 31).bitwiseOR(d).alias(low)]


def members(turns: DataFrame, rule: TrieRule = TrieRule(), salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(paths, conversations)``: one row for each conversation and depth, stored; and one for each conversation.

    A path row has the node's element ``(hi, lo)``, its parent's ``(up_hi, up_lo)``, the digest of
    the last turn, and the words before it, ``above``.
    """
    scanned = cut_lineage(scan_turns(turns, rule, salt))
    convs = cut_lineage(_conversations(scanned, rule))
    part = (F.col("pos") / rule.span).cast("bigint")
    parts = convs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") / rule.span).cast("bigint"))))
    own = scanned.withColumn("part", part).join(parts.drop("base", "n", "length", "total"), ["conv_id", "part"]).where("pos > head")
    joined = lambda k, own: (F.col(f"a{k}") + F.col(f"f{k}") * F.col(f"{own}{k}") % PRIMES[k]) % PRIMES[k]
    ks = range(len(PRIMES))
    own = own.select(
        "conv_id",
        (F.col("pos") - F.col("back")).alias("depth"),
        *_packed([joined(k, "p") for k in ks], "hi", "lo"),
        *_packed([joined(k, "q") for k in ks], "up_hi", "up_lo"),
        "digest",
        (F.col("add_words") + F.col("words") - F.col("own")).alias("above"),
    )
    heads = scanned.where((F.col("pos") < rule.heads) & (F.col("conv_id") % rule.every == 0)).withColumnRenamed("conv_id", "base")
    lent = convs.select("conv_id", "base", "borrowed").join(heads, "base").where("pos <= borrowed")
    lent = lent.select(
        "conv_id",
        F.col("pos").alias("depth"),
        *_packed([F.col(f"p{k}") for k in ks], "hi", "lo"),
        *_packed([F.col(f"q{k}") for k in ks], "up_hi", "up_lo"),
        "digest",
        (F.col("words") - F.col("own")).alias("above"),
    )
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("hi"), zero.alias("lo"), zero.alias("up_hi"), zero.alias("up_lo"), F.lit(None).cast("binary").alias("digest"), zero.alias("above"))
    return cut_lineage(own.union(lent).union(roots)), convs


def _nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes with their proof: one row for each element, parent's element and last turn."""
    lengths = convs.select("conv_id", F.col("length").alias("depth"), F.lit(1).alias("ends"))
    ended = paths.join(lengths, ["conv_id", "depth"], "left")
    return cut_lineage(ended.groupBy("depth", "hi", "lo", "up_hi", "up_lo", "digest").agg(F.min("conv_id").alias("label"), (F.count(F.lit(1)) == F.count("ends")).alias("childless"), F.min("above").alias("above")))


def _labels(nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """Per conversation: ``top``, the words above that depth, whether it stands for a leaf, and the parent of its top node."""
    firsts = nodes.groupBy("label").agg(
        F.min("depth").alias("top"), F.min_by("above", "depth").alias("top_words"), F.min_by(F.struct("up_hi", "up_lo"), "depth").alias("up"), F.max("childless").alias("leaf")
    )
    firsts = firsts.select("label", "top", "top_words", "leaf", F.col("up.up_hi").alias("hi"), F.col("up.up_lo").alias("lo"), (F.col("top") - 1).alias("depth"), F.pmod(F.xxhash64("label"), F.lit(64)).alias("salt"))
    firsts = cut_lineage(firsts)
    key = ["depth", "hi", "lo"]
    # a parent with very many children is asked for once by each salt
    asked = firsts.where("top > 0").select(*key, "salt").distinct().join(nodes.select(*key, F.col("label").alias("parent")), key)
    placed = firsts.join(asked, [*key, "salt"], "left").select(F.col("label").alias("conv_id"), "top", "top_words", "leaf", "parent")
    every = convs.select("conv_id", "length", "total").join(placed, "conv_id", "left")
    return every.select(
        "conv_id", "length", F.coalesce("top", F.col("length") + 1).alias("top"), F.coalesce("top_words", "total").alias("top_words"), F.coalesce("leaf", F.lit(False)).alias("leaf"), "parent"
    )


def _end_hashes(ends: DataFrame, rule: TrieRule) -> DataFrame:
    """``(depth, hi, lo, ends_sha256)`` of rows ``(depth, hi, lo, conv_id)``: ids ascending, comma-joined.

    Ids are put in order and joined into pieces by all tasks; the hash, which can only be
    taken in order, then reads pieces, one at a time.
    """
    key = ["depth", "hi", "lo"]
    kinds = "depth bigint, hi bigint, lo bigint"

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, ids = None, []

        def piece(k, members):
            return pa.RecordBatch.from_pylist([{"depth": k[0], "hi": k[1], "lo": k[2], "first": members[0], "ids": ",".join(map(str, members))}], schema=out)

        out = pa.schema([(c, pa.int64()) for c in (*key, "first")] + [("ids", pa.string())])
        for batch in batches:
            done = []
            for *k, c in zip(*[batch.column(name).to_pylist() for name in (*key, "conv_id")]):
                if ids and (k != open_key or len(ids) >= rule.piece):
                    done.append(piece(open_key, ids))
                    ids = []
                open_key = k
                ids.append(c)
            yield from done
        if ids:
            yield piece(open_key, ids)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([(c, pa.int64()) for c in key] + [("ends_sha256", pa.string())])
        open_key, state = None, None
        for batch in batches:
            done = []
            for *k, text in zip(*[batch.column(name).to_pylist() for name in (*key, "ids")]):
                if k == open_key:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    done.append([*open_key, state.hexdigest()])
                open_key, state = k, hashlib.sha256(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=out)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*open_key, state.hexdigest())], schema=out)

    pieces = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(join_ids, f"{kinds}, first bigint, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, f"{kinds}, ends_sha256 string")


def prefix_trie(turns: DataFrame, rule: TrieRule = TrieRule()) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, from the root on.

    ``conv_id``: smallest member; ``depth``; ``parent_conv_id``: the parent's (root: null);
    ``n_convs``: members; ``n_children``; ``n_leaves``: childless nodes of the subtree;
    ``saved_tokens``: over the subtree, words of each node's turn that members beyond the first repeat;
    ``ends_sha256``: of the ids that end here, ascending, comma-joined (none: of the empty text).

    Null roles and texts are empty, turns without a ``conv_id`` are left out, turns at one
    place are ordered by role and then by their digest, repeated rows are turns of their
    own, other columns are ignored.  No turns, no nodes.
    """
    for salt in range(16):
        paths, convs = members(turns.select("conv_id", "turn", "role", "text"), rule, salt)
        nodes = _nodes(paths, convs)
        if nodes.groupBy("depth", "hi", "lo").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError("prefix fingerprints collide under every salt")
    labels = cut_lineage(_labels(nodes, convs))
    part = (F.col("depth") / rule.span).cast("bigint")
    parts = labels.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("length") / rule.span).cast("bigint"))))
    rows = paths.withColumn("part", part).join(parts, ["conv_id", "part"])
    depth, top = F.col("depth"), F.col("top")
    key = ["depth", "hi", "lo"]
    found = rows.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"),
        F.max(F.when(top < depth, F.col("conv_id")).when(top == depth, F.col("parent"))).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(((top <= depth + 1) & (depth < F.col("length"))).cast("bigint")).alias("n_children"),
        F.sum(F.col("leaf").cast("bigint")).alias("n_leaves"),
        F.sum(F.when(top > depth, F.col("top_words") - F.col("above")).otherwise(0)).alias("saved_tokens"),
    )
    ends = rows.where("depth = length").select(*key, "conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.join(_end_hashes(ends, rule), key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )
