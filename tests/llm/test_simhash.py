import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import HARD, SF, Union, docs
from tidemark.llm import simhash
from tidemark.llm.queries import QUERIES
from tidemark.session import read_table


def plain_fingerprint(text: str, size: int) -> int:
    import re

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abÄé \t\nAB\x0b\x1c", max_size=60), st.integers(1, 5))
def test_fingerprint(text, size):
    assert simhash.fingerprint(text.encode(), size) == plain_fingerprint(text, size)


def test_long_fingerprint_runs_over_pieces():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(20_000))
    assert simhash.fingerprint(text.encode(), 3) == plain_fingerprint(text, 3)


def test_code_is_perfect():
    words = np.arange(1 << 23)
    syndrome = simhash._syndromes(words)
    leaders = [min(p.bit_count() for p in simhash._TABLE[s, : simhash._COUNT[s]].tolist()) for s in range(2048)]
    assert max(leaders) == 3 and (np.bincount(syndrome) == 4096).all()
    codewords = words[syndrome == 0]
    assert min(int(c).bit_count() for c in codewords[1:]) == 7
    assert len(set((codewords >> 11).tolist())) == 4096


def test_links_share_a_key():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(3)):
            b ^= 1 << rng.randrange(64)
        keys = [set(simhash.golay_keys(np.array([x], np.uint64).view(np.int64))[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def brute_classes(fps: dict[int, int]) -> dict[int, int]:
    groups, items = Union(fps), sorted(fps)
    for k, a in enumerate(items):
        for b in items[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                groups.join(a, b)
    return {x: groups.find(x) for x in items}


def test_classes_match_all_pairs_on_the_table(spark):
    rows = QUERIES["op2_simhash_near_dedup"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    fps = {i: plain_fingerprint(t or "", 3) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == fps and all(len(r.fingerprint) == 16 for r in rows)
    assert {r.doc_id: r.component_id for r in rows} == brute_classes(fps)


def test_dense_groups_link_exactly_with_and_without_pairs(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(220):
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    expected = brute_classes(dict(enumerate(fps)))
    for limit in (2, 16, 1000):
        groups = Union(range(len(fps)))
        place = {f: k for k, f in enumerate(fps)}
        for r in simhash.links(table, simhash.SimHashRule(pair_limit=limit)).collect():
            a, b = r.a % (1 << 64), r.b % (1 << 64)
            assert (a ^ b).bit_count() <= 2
            groups.join(place[a], place[b])
        assert {k: groups.find(k) for k in range(len(fps))} == expected


def test_hard_rows(spark):
    table = docs(spark, [*HARD, (None, "a b c d"), (20, "a b c d")])
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(table).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (5, 5), (None, None)} <= found
    kept = simhash.keep_representatives(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6, 7, 9, 10, 20]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
