import random

import corpus_pipeline
import pytest

from tests.llm.helpers import HARD, SF_MID, Union, docs
from tidemark.llm import bbit, jaccard, simhash
from tidemark.session import read_table


def plain_set(text: str, size: int = 5) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute_classes(texts: dict, threshold: float = 0.8) -> dict:
    sets = {i: plain_set(t) for i, t in texts.items()}
    groups, items = Union(sets), sorted(sets)
    for k, a in enumerate(items):
        for b in items[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) / len(x | y) >= threshold):
                groups.join(a, b)
    return {x: groups.find(x) for x in items}


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_joins_what_jaccard_joins_on_the_table(spark):
    table = read_table(spark, SF_MID, "documents")
    classes = brute_classes({r.doc_id: r.text for r in table.collect()})
    kept = corpus_pipeline.drop_near_duplicates(spark, table, SF_MID)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))


@pytest.mark.parametrize("limit", [2, 16])
def test_groups_match_all_pairs(spark, limit):
    rng = random.Random(5)
    texts = {}
    for base in range(4):
        words = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(30):
            texts[len(texts)] = changed(rng, words, rng.randrange(6))
    found = jaccard.near_duplicates(docs(spark, list(texts.items())), jaccard.JaccardRule(pair_limit=limit))
    expected = brute_classes(texts)
    assert len(set(expected.values())) not in (4, len(texts))
    assert {r.doc_id: r.component_id for r in found.collect()} == expected


def test_hard_rows(spark):
    table = docs(spark, [*HARD, (None, "a b c d"), (20, "a B\tc d"), (21, "A b c d")])
    kept = jaccard.keep_representatives(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6, 7, 9, 10, 20]
    assert jaccard.keep_representatives(docs(spark, [])).count() == 0


def test_fingerprints_give_candidates_and_sets_confirm_them(spark):
    rng = random.Random(9)
    texts = {0: "x " * 100, 1: "x " * 100 + "y z w"}
    for _ in range(3):
        words = [f"w{rng.randrange(3000)}" for _ in range(900)]
        for _ in range(8):
            texts[len(texts)] = changed(rng, words, 1)
    fps = {i: simhash.fingerprint(t.encode(), 3) for i, t in texts.items()}
    assert fps[0] == fps[1]
    alone = jaccard.JaccardRule(bands=1, rows=400)  # bands that only equal sets share
    found = jaccard.near_duplicates(docs(spark, list(texts.items())), alone, simhash.SimHashRule())
    groups = Union(texts)
    for a in texts:
        for b in texts:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                groups.join(a, b)
    near = brute_classes(texts)
    expected = {i: groups.find(i) if near[groups.find(i)] == near[i] else i for i in texts}
    assert expected[1] == 1 and len(set(expected.values())) < len(texts)
    assert {r.doc_id: r.component_id for r in found.collect()} == expected


def test_stage_asks_the_fingerprint_operator(spark, monkeypatch):
    asked, plain = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *args: asked.append(args) or plain(*args))
    assert corpus_pipeline.drop_near_duplicates(spark, docs(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, "z")]), SF_MID).count() == 2
    assert len(asked) == 1


def test_copies_in_large_buckets_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{rng.randrange(3000)}" for _ in range(120)]
    texts = dict(enumerate([changed(rng, words, 4) for _ in range(60)] + [changed(rng, words, 1) for _ in range(6)]))
    compared, plain = [], bbit._proven
    monkeypatch.setattr(bbit, "_proven", lambda pairs, *args, **named: compared.append(pairs.count()) or plain(pairs, *args, **named))
    found = jaccard.near_duplicates(docs(spark, list(texts.items())))
    assert {r.doc_id: r.component_id for r in found.collect()} == brute_classes(texts)
    assert compared and sum(compared) < len(texts) * (len(texts) - 1) / 4
