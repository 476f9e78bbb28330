import random

import numpy as np
import pytest

from tests.llm.helpers import HARD, SF, docs, matches_sql
from tidemark.llm import recipes
from tidemark.llm.queries import ORACLES, QUERIES

TINY = recipes.ChunkRule(least=32, most=200, mean_bits=5)


def plain(rows):
    import hashlib

    norm = {k: (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)}) for k, (_, t) in enumerate(rows)}
    groups: dict[str, list[int]] = {}
    for k, text in norm.items():
        groups.setdefault(text, []).append(k)
    out = []
    for k, (i, _) in enumerate(rows):
        members = groups[norm[k]]
        best = min(members, key=lambda m: (-len(rows[m][1] or ""), rows[m][0] is None, rows[m][0] or 0))
        out.append((i, rows[best][0], len(members), i == rows[best][0], hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def random_rows(n):
    rng = random.Random(8)
    words = [f"wörd{k}" for k in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))) for _ in range(8)]
    rows = []
    for i in range(n):
        text = rng.choice(base)
        if rng.random() < 0.3:
            text = text.replace(" ", rng.choice(["  ", "\n", "\t "]))
        if rng.random() < 0.2:
            text += rng.choice("xyz")
        rows.append((rng.randrange(n), text))
    return rows


def test_cuts_depend_on_the_text_alone():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 5000, np.uint8).tobytes()
    raw = [rng.integers(97, 123, n, np.uint8).tobytes() for n in (10, 3000, 1)]
    alone = next(recipes._chunks([text], TINY))
    assert list(recipes._chunks([*raw, text], TINY))[-1] == alone
    assert b"".join(alone) == text and all(32 <= len(c) <= 200 for c in alone[:-1])
    shifted = next(recipes._chunks([b"zz" + text], TINY))
    assert len(set(shifted) & set(alone)) > len(alone) // 2


def test_groups_match_comparing_texts(spark):
    rows = random_rows(120)
    for rule in (recipes.ChunkRule(), TINY):
        assert found(recipes.exact_duplicates(docs(spark, rows), rule)) == plain(rows)


def test_digests_that_two_chunks_share_are_given_up(spark):
    rows = random_rows(60)
    rule = recipes.ChunkRule(least=32, most=200, mean_bits=5, digest_bytes=(1, 16))
    assert found(recipes.exact_duplicates(docs(spark, rows), rule)) == plain(rows)
    with pytest.raises(ValueError):
        recipes.verified_recipes(docs(spark, rows), recipes.ChunkRule(least=32, most=200, mean_bits=5, digest_bytes=(1,)))


def test_query_matches_sql(spark):
    matches_sql(QUERIES["op7_exact_dedup"](spark, SF), ORACLES["op7_exact_dedup"], SF)


def test_hard_rows(spark):
    rows = [*HARD, (None, "a"), (None, "alone")]
    table = docs(spark, rows)
    assert found(recipes.exact_duplicates(table)) == plain(rows)
    assert recipes.keep_distinct(table).columns == table.columns
    assert recipes.exact_duplicates(docs(spark, [])).count() == 0
