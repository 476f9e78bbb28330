import random

import numpy as np
import pytest

from tests.llm.helpers import HARD, SF_MID, Union, docs
from tests.llm.test_jaccard import changed, plain_set
from tidemark.llm import bbit, queries
from tidemark.session import read_table


def brute(rows, percent=85):
    """``(doc_id, n, component, kept)`` by comparing all pairs of sets."""
    sets = [(i, plain_set(t, 3)) for i, t in rows]
    groups = Union({i for i, _ in sets})
    distinct = sorted({s: None for _, s in sets if s}, key=len)
    owners = {}
    for i, s in sets:
        if s:
            groups.join(owners.setdefault(s, i), i)
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            if 100 * len(a & b) >= percent * len(a | b):
                groups.join(owners[a], owners[b])
    return sorted((i, len(s), groups.find(i), groups.find(i) == i) for i, s in sets)


def rows_of(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(tuple(r) for r in df.collect())


def test_query_on_the_table(spark):
    table = [(r.doc_id, r.text) for r in read_table(spark, SF_MID, "documents").collect()]
    expected = brute(table)
    assert any(c != i for i, _, c, _ in expected)
    assert rows_of(queries.QUERIES["op13_bbit_minhash"](spark, SF_MID)) == expected


@pytest.mark.parametrize("limit, leaders", [(2, 1), (2, 4), (16, 4)])
def test_groups_match_all_pairs(spark, limit, leaders):
    rng = random.Random(8)
    texts = []
    for base in range(3):
        words = [f"w{rng.randrange(3000)}" for _ in range(150)]
        texts += [changed(rng, words, rng.randrange(9)) for _ in range(30)]
    # chains: every text near its neighbours only
    words = [f"c{k}" for k in range(200)]
    for k in range(12):
        words[k * 15 : k * 15 + 5] = [f"c{k}x{j}" for j in range(5)]
        texts.append(" ".join(words))
    table = list(enumerate(texts))
    expected = brute(table)
    assert 4 < len({c for *_, c, _ in expected}) < len(texts)
    assert rows_of(bbit.near_duplicates(docs(spark, table), bbit.BBitRule(pair_limit=limit, leaders=leaders))) == expected


def test_hard_rows(spark):
    table = docs(spark, [*HARD, (20, "a B\tc d"), (21, "A b c d"), (21, "A b c d"), (22, "a b"), (23, "A\nB"), (24, "a b c")])
    expected = brute([(r.doc_id, r.text) for r in table.collect()])
    assert rows_of(bbit.near_duplicates(table)) == expected
    nobody = rows_of(bbit.near_duplicates(docs(spark, [(None, "a b c d")])))
    assert nobody == [(None, 2, None, True)]
    assert rows_of(bbit.near_duplicates(docs(spark, []))) == []
    kept = bbit.keep_representatives(docs(spark, [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (3, "")]))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) in ([(0, "a b c d"), (1, "a b c d"), (3, None)], [(0, "a b c d"), (1, "a b c d"), (3, "")])


def test_estimate_is_corrected_and_the_cut_is_below_the_threshold(spark):
    rule, rng = bbit.BBitRule(), np.random.default_rng(4)
    common = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    rows, truth = [], []
    for shared in (0, 300, 600, 800, 850, 900):
        other = np.concatenate([common[:shared], rng.integers(0, 1 << 63, 900 - shared, dtype=np.uint64)])
        both = np.concatenate([np.unique(common), np.unique(other)])
        values = bbit.minima(both, np.array([0, len(np.unique(common)), len(both)]), rule.bands * rule.rows)
        a, b = bbit.packed(values).view(np.int64).tolist()
        rows.append((len(rows), a, b, int((values[0] & np.uint64(3) == values[1] & np.uint64(3)).sum())))
        truth.append(shared / (1800 - shared))
    frame = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>, n int")
    matching = bbit.matches(frame["a"], frame["b"], rule)
    found = frame.select("k", "n", matching.alias("m"), bbit.estimate(matching, rule).alias("s")).orderBy("k").collect()
    for r, similarity in zip(found, truth):
        assert r.m == r.n and abs(r.s - similarity) < 0.15
        assert similarity < 0.85 or r.m >= rule.least_matches
    assert 0.25 * 160 < rule.least_matches < (0.25 + 0.75 * 0.85) * 160


def test_leaders_of_one_component_are_one(spark, monkeypatch):
    # bucket k holds ten of twenty linked sets, each time others, and two that are similar to each other only
    apart = list(range(60, 160))
    items = {f"m{k:02}": [*range(k), *range(k + 1, 100)] for k in range(20)} | {"x": apart, "y": [*apart[:-1], 500]}
    hot = [(k, h, 0, "m00" if h[0] == "m" else h) for k in range(11) for h in [*(f"m{m:02}" for m in range(k, k + 10)), "x", "y"]]
    hot = spark.createDataFrame(hot, "key bigint, h string, order bigint, c string")
    sets = spark.createDataFrame(list(items.items()), "h string, items array<bigint>")
    seen, plain = [], bbit.lookup
    monkeypatch.setattr(bbit, "lookup", lambda rows, *args: (seen.append(rows) if args[1] == "leader" else None) or plain(rows, *args))
    pairs = bbit._by_differences(hot, sets.selectExpr("h", "size(items) AS n"), sets, bbit.BBitRule())
    assert {("x", "y"), ("y", "x")} <= {(r.a, r.b) for r in pairs.collect()}
    (members,) = seen
    assert sorted(r.h for r in members.collect()) == sorted(items)


def test_buckets_of_one_component_are_not_compared_again(spark, monkeypatch):
    # bucket 0 holds linked sets only; in bucket 1 are some of them and two that are similar to each other only
    apart = list(range(60, 160))
    items = {f"m{k:02}": [*range(k), *range(k + 1, 100)] for k in range(20)} | {"x": apart, "y": [*apart[:-1], 500]}
    hot = [(0, h, 0, "m00") for h in items if h[0] == "m"] + [(1, h, 0, "m00" if h[0] == "m" else h) for h in ["m00", "m01", "m02", "x", "y"]]
    hot = spark.createDataFrame(hot, "key bigint, h string, order bigint, c string")
    sets = spark.createDataFrame(list(items.items()), "h string, items array<bigint>")
    seen, plain = [], bbit.lookup
    monkeypatch.setattr(bbit, "lookup", lambda rows, *args: (seen.append(rows) if args[1] == "leader" else None) or plain(rows, *args))
    pairs = bbit._by_differences(hot, sets.selectExpr("h", "size(items) AS n"), sets, bbit.BBitRule())
    assert {("x", "y"), ("y", "x")} <= {(r.a, r.b) for r in pairs.collect()}
    (members,) = seen
    assert sorted(r.h for r in members.collect()) == ["m00", "m01", "m02", "x", "y"]
