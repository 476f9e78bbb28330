import hashlib
import random
import zlib

import pytest

from tests.llm.helpers import SF_MID, sql_rows
from tidemark.llm import prefixtrie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Every prefix as a tuple of turns, every subtree walked."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    def digest(r):
        return hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    own = {c: [r[2:] for r in sorted(turns, key=lambda r: (r[:3], digest(r)))] for c, turns in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {}
    for node in members:
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    parents = {node[:-1] for node in members if node}
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(rebuilt[c]) == len(node))))
        out.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(1 for n in below[node] if len(n) == len(node) + 1),
            sum(n not in parents for n in below[node]), sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below[node] if n),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], "conv_id bigint, turn int, role string, text string, depth string, label string, hi string").repartition(3)


def check(spark, rows, **rule):
    found = prefixtrie.prefix_trie(table(spark, rows), prefixtrie.TrieRule(**rule))
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_query_matches_sql(spark):
    found = queries.op11_conversation_prefix_trie(spark, SF_MID)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sql_rows(queries.ORACLES["op11_conversation_prefix_trie"], SF_MID, COLUMNS)


@pytest.mark.parametrize("span, piece", [(256, 65536), (2, 3)])
def test_random_conversations_match_walked_trees(spark, span, piece):
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ab"), rng.choice(["x y", "x  z\ty", "long er text"])) for c in range(70) if c not in (20, 41) for t in range(rng.choice([1, 2, 3, 5]))]
    # one conversation far longer than the others, copies of it, and copies that end earlier
    rows += [(c, t, "u", f"w{t % 7} again") for c in (300, 301, 302, 320, 340) for t in range(40 - c // 20)]
    rng.shuffle(rows)
    check(spark, rows, span=span, piece=piece)


def test_nulls_ties_repeats_and_absent_bases(spark):
    rows = [
        (None, 0, "user", "nobody"), (0, None, None, None), (0, 3, "user", "a b"), (0, 3, "user", "a b"), (0, 3, "assistant", "a b"), (0, 3, "user", "b a"),
        (45, 1, "user", "base is absent"), (46, 9, "", ""), (47, 9, None, ""), (1, -5, "user", "a"), (2, 2**31 - 1, "user", "日本 \x0b語" * 900), (22, 0, "user", "turnless or not"), (23, 0, "u", "t"), (24, 0, "u", "t"), (25, 0, "u", "t"),
    ]
    check(spark, rows, span=2)


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400) for t in range(3)]
    check(spark, rows, piece=7)


def test_no_rows(spark):
    found = prefixtrie.prefix_trie(table(spark, [(None, 1, "a", "b")]).limit(0))
    assert found.columns == COLUMNS and found.count() == 0


def test_a_collision_is_found_and_other_hashes_are_taken(spark, monkeypatch):
    rows = [(c, t, "user", f"{c} {t}") for c in range(4) for t in range(2)]
    right, tried = prefixtrie.members, []

    def colliding(turns, rule, salt):
        paths, convs = right(turns, rule, salt)
        tried.append(salt)
        return (paths.selectExpr("conv_id", "depth", "0L hi", "0L lo", "0L up_hi", "0L up_lo", "digest", "above"), convs) if salt == 0 else (paths, convs)

    monkeypatch.setattr(prefixtrie, "members", colliding)
    check(spark, rows)
    assert tried == [0, 1]
