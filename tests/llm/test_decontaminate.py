import random
import re

from tests.llm.helpers import HARD, SF_MID, docs, matches_sql
from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import Containment
from tidemark.llm.queries import ORACLES, QUERIES


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def grams(w, size):
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def brute(rows, items, rule=Containment()):
    out = []
    for i, text in rows:
        have = words(text)
        for j, item in items:
            own = words(item)
            if j is None or not own:
                continue
            size = min(len(own), rule.words)
            needed = grams(own, size)
            shared = len(needed & grams(have, size))
            if shared >= rule.threshold * len(needed) - 1e-9 and shared:
                out.append((i, j, shared, len(needed)))
    return sorted(out, key=str)


def found(spark, rows, items, rule=Containment()):
    bench = spark.createDataFrame([(j, t, None) for j, t in items], "item_id bigint, text string, doc_id string")
    df = decontaminate.contained_items(docs(spark, rows), bench, rule)
    return sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in df.collect()), key=str)


def planted(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["éa", "日本"]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 45, 80])))) for j in range(40)]
    rows = []
    for i in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 400))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in part]
        rows.append((i, rng.choice([" ", "\n", " | "]).join(text)))
    return rows, items


def test_all_contained_items_are_found(spark):
    rows, items = planted()
    for rule in (Containment(), Containment(threshold=0.5), Containment(words=3, threshold=1.0)):
        expected = brute(rows, items, rule)
        assert len(expected) > 20 and found(spark, rows, items, rule) == expected


def test_blocks_of_items_give_the_same(spark):
    rows, items = planted(2)
    assert found(spark, rows, items, Containment(block_bytes=700)) == brute(rows, items)


def test_sketches_grow_with_the_size_class():
    items = [(n, " ".join(f"a{n}x{k}" for k in range(n)).encode()) for n in (5, 12, 40, 300)]
    block = decontaminate.ItemBlock(items, Containment())
    held = [sum(k in o for o in block.owners) for k in range(4)]
    assert held[0] == 1 and held[1] == 8 // 5 + 1 and held[3] == 296 // 5 + 1 and held == sorted(held)


def test_query_matches_sql(spark):
    matches_sql(QUERIES["op10_decontamination"](spark, SF_MID), ORACLES["op10_decontamination"], SF_MID)


def test_hard_rows(spark):
    items = [(1, None), (2, ""), (3, "!!"), (4, "a"), (5, "über lange wörter AND more of them über"), (5, "über lange wörter AND more of them über"), (None, "a"), (6, "Nul")]
    expected = brute(HARD, [x for x in items if x[0] != 5] + [items[4]])
    assert set(found(spark, HARD, items)) == set(expected)
    assert found(spark, [], items) == [] and found(spark, HARD, []) == []
    bench = spark.createDataFrame([(4, "a")], "item_id bigint, text string")
    table = docs(spark, [*HARD, (None, "a"), (None, "b")])
    clean = decontaminate.decontaminate(table, bench)
    assert clean.columns == table.columns
    assert sorted((r.doc_id or 0) for r in clean.collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 10]
