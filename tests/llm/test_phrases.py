import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import HARD, SF_MID, sql_rows
from tidemark.llm import phrases, queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, rule):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, rule.longest + 1) for i in range(len(words) - k + 1))
    often = {key: a for key, a in counts.items() if a >= rule.least}
    covered = {}
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                covered[lang, w[i : i + k]] = max(a, covered.get((lang, w[i : i + k]), 0))
    found = []
    for (lang, w), a in often.items():
        if len(w) > 1 and covered.get((lang, w), 0) < a:
            cuts = [(1000 * a * sizes[lang] // (often[lang, w[:k]] * often[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((lang, -score, -a, " ".join(w).encode(), often[lang, w[:k]], often[lang, w[k:]]))
    out, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        place[lang] += 1
        if place[lang] <= rule.top:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, sizes[lang], -score))
    return out


def table(spark, rows):
    data = [(k, lang, text, None, None) for k, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id bigint, lang string, text string, phrase string, n string").repartition(3)


def check(spark, rows, rule):
    found = phrases.collocations(table(spark, rows), rule)
    assert found.columns == COLUMNS
    result = sorted(tuple(r) for r in found.collect())
    assert result == sorted(brute(rows, rule))
    return result


def test_query_matches_sql(spark):
    found = queries.op12_phrase_collocations(spark, SF_MID)
    rows = sorted((tuple(r) for r in found.select(COLUMNS).collect()), key=str)
    assert len(rows) > 50 and rows == sql_rows(queries.ORACLES["op12_phrase_collocations"], SF_MID, COLUMNS)


@pytest.mark.parametrize("shards, slots, held", [(3, 1 << 16, 1 << 20), (2, 8, 40), (4, 1 << 16, 300)])
def test_random_texts_match_counted_phrases(spark, shards, slots, held):
    rng = random.Random(shards)
    words = ["a", "B", "the", "of", "ça", "x1"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",\n"]) for _ in range(60))) for _ in range(40)]
    # a phrase that is in few documents, one that is in the last only, and its parts elsewhere
    rows += [("en", "one two three four five six, " * 12), ("en", "seven eight. " * 30 + "seven nine; nine eight"), (None, "last of all " * 11)]
    result = check(spark, rows, phrases.PhraseRule(least=10, shards=shards, filter_slots=slots, held_words=held, block_words=100, slice_bytes=256))
    assert {len(r[2].split()) for r in result} >= {2, 3, 5}


def test_ties_are_ranked_by_text_and_the_list_ends(spark):
    rows = [("en", f"{a} {b}.") for a, b in [("z", "y"), ("é", "f"), ("k", "l"), ("m", "n")] for _ in range(5)]
    result = check(spark, rows, phrases.PhraseRule(least=5, top=3))
    assert [r[2] for r in result] == ["k l", "m n", "z y"]


def test_hard_rows(spark):
    rows = [("en", t) for _, t in HARD] + [(None, None), ("", "a b a b a b"), (None, "日本 語\x00。 日本 語\x00"), ("und", "日本 語\x00")]
    check(spark, rows, phrases.PhraseRule(least=3, top=50))
    empty = phrases.collocations(table(spark, rows).limit(0))
    assert empty.columns == COLUMNS and empty.count() == 0


def test_phrases_are_active_for_one_cycle():
    rule = phrases.PhraseRule(shards=2, filter_slots=1 << 20)
    ids = np.array([5, 6, 0, 5, 6], np.uint64)
    hashes = [phrases.bytetext.mix(np.array([i], np.uint64) ^ phrases._lang_hash("en")) for i in (5, 6)]
    slots = [int(phrases._slots(h, rule.filter_slots)[0]) for h in hashes]
    seen = {}
    for scan in range(6):
        reached = np.zeros(rule.filter_slots, np.uint8)
        # the first word is reached in scan 0, the second in scan 1
        reached[slots[0]] = 1 if scan > 0 else 0
        reached[slots[1]] = 2 if scan > 1 else 0
        seen[scan] = {length: places.tolist() for length, places, _ in phrases.active_phrases("en", ids, reached, scan, rule)}
    assert seen == {0: {1: [0, 1, 3, 4]}, 1: {1: [0, 1, 3, 4]}, 2: {2: [0, 3]}, 3: {2: [0, 3]}, 4: {}, 5: {}}


def test_long_texts_are_cut_between_pieces():
    data = np.frombuffer(b"aa bb. cc dd, ee " + b"x" * 50 + b". y", np.uint8)
    cuts = phrases._cuts(data, 12)
    assert [data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] == [b"aa bb. cc dd,", b" ee " + b"x" * 50 + b".", b" y"]


def test_plans_do_not_grow_with_the_scans(spark, monkeypatch):
    sizes, plain = [], phrases._counted_when_active

    def seen(rows, reached, rule):
        out = plain(rows, reached, rule)
        sizes.append(out._jdf.queryExecution().analyzed().toString().count("Relation"))
        return out

    monkeypatch.setattr(phrases, "_counted_when_active", seen)
    table = spark.createDataFrame([(k, "a b c d e f g", "en") for k in range(12)], "doc_id bigint, text string, lang string")
    phrases.collocations(table, phrases.PhraseRule(least=4))
    assert len(sizes) > 4 and max(sizes[1:]) == min(sizes[1:])
