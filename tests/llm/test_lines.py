import random

from pyspark.sql import functions as F

from tests.llm.helpers import HARD, SF, Union, docs
from tidemark.llm import lines
from tidemark.llm.queries import QUERIES
from tidemark.session import read_table


BLANK = " \t\n\x0b\x0c\r"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(rng, text: str, edits: int, letters: str) -> str:
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(letters)
        elif kind == 1:
            out.insert(at, rng.choice(letters))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def brute(rows, rule):
    """doc_id -> text left, by comparing all pairs of distinct lines."""
    places: dict[str, tuple] = {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n")):
            if line.strip(BLANK) and line not in places:
                places[line] = (i, k)
    groups, every = Union(places.values()), sorted(x for x in places if len(x) >= rule.least_chars)
    for k, a in enumerate(every):
        for b in every[k + 1 :]:
            if abs(len(a) - len(b)) <= rule.edits and distance(a, b) <= rule.edits:
                groups.join(places[a], places[b])
    out = []
    for i, text in rows:
        if i is None or text is None:
            out.append((i, text))
            continue
        kept = [x for k, x in enumerate(text.split("\n")) if not x.strip(BLANK) or (i, k) <= groups.find(places[x])]
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def cleaned(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_banded_distance(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(3, 60)))
        b = mutated(rng, a, rng.randrange(5), "abcé日")
        pairs.append((a, b) if len(a) >= len(b) else (b, a))
    for edits in (1, 2, 3):
        table = spark.createDataFrame(pairs, "l string, s string")
        near, may = lines.within_edits(F.col("l"), F.col("s"), edits), lines.may_be_within(F.col("l"), F.col("s"), edits)
        middle = lines.unlike_middle(F.col("l"), F.col("s"))
        for r in table.select("l", "s", near.alias("near"), may.alias("may"), middle.alias("p")).collect():
            assert distance(r.p.l, r.p.s) == distance(r.l, r.s)
            assert r.near == (distance(r.l, r.s) <= edits), (r, edits)
            assert r.may or not r.near


def random_rows(rng, n, letters="ab cé"):
    seeds = ["".join(rng.choice(letters) for _ in range(rng.randrange(8, 20))) for _ in range(12)]
    rows = []
    for i in range(n):
        picked = [mutated(rng, rng.choice(seeds), rng.choice([0, 0, 1, 2, 3]), letters) if rng.random() < 0.8 else rng.choice(["", "short"]) for _ in range(rng.randrange(1, 5))]
        rows.append((i, "\n".join(picked)))
    return rows


def test_classes_match_all_pairs(spark):
    rng = random.Random(7)
    rows = random_rows(rng, 60)
    for rule in (lines.LineRule(least_chars=8), lines.LineRule(least_chars=8, edits=1), lines.LineRule(least_chars=8, pair_limit=2)):
        assert cleaned(lines.dedup_lines(docs(spark, rows), rule)) == brute(rows, rule), rule


def test_large_buckets_are_divided_and_stay_exact(spark):
    rng = random.Random(3)
    head, tail = "the very same beginning of a line ", " and the very same end of it all"
    rows = [(i, head + "".join(rng.choice("xyz") for _ in range(6)) + tail) for i in range(90)]
    rule = lines.LineRule(pair_limit=4)
    assert cleaned(lines.dedup_lines(docs(spark, rows), rule)) == brute(rows, rule)


def test_copies_of_a_line_are_keyed_once(spark, monkeypatch):
    line = "a line that stands in a third of all rows of the table"
    rows = [(i, f"{line}\nand one more that is of this row alone: {i * i:09d}") for i in range(200)]
    keyed, plain = [], lines.segment_keys
    monkeypatch.setattr(lines, "segment_keys", lambda texts, edits: keyed.append(texts.count()) or plain(texts, edits))
    rule = lines.LineRule()
    assert cleaned(lines.dedup_lines(docs(spark, rows), rule)) == brute(rows, rule)
    assert keyed == [201]


def test_query_on_the_table(spark):
    rule = lines.LineRule()
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    import hashlib

    expected = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute_by_length(rows, rule)}
    found = QUERIES["op5_line_dedup"](spark, SF).collect()
    assert {r.doc_id: r.kept_sha256 for r in found} == expected
    assert {r.doc_id: r.n_lines for r in found} == {i: len(t.split("\n")) for i, t in rows}


def brute_by_length(rows, rule):
    """As ``brute``, but pairs without a common run of a third of the line are not compared."""
    places: dict[str, tuple] = {}
    for i, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            if line.strip(BLANK) and line not in places:
                places[line] = (i, k)
    groups, every = Union(places.values()), sorted((x for x in places if len(x) >= rule.least_chars), key=len)
    for k, a in enumerate(every):
        for b in every[k + 1 :]:
            if len(b) - len(a) > rule.edits:
                break
            third = len(a) // (rule.edits + 1)
            if any(a[s : s + third] in b for s in range(0, third * (rule.edits + 1), third)) and distance(a, b) <= rule.edits:
                groups.join(places[a], places[b])
    return [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip(BLANK) or (i, k) <= groups.find(places[x]))) for i, t in rows]


def test_short_lines_repeat_where_they_are_equal(spark):
    rows = [(1, "Home | About\none"), (2, "Home | About\ntwo\n \n"), (3, "Home | Abouts"), (4, "Home | About\n \n}")]
    assert cleaned(lines.dedup_lines(docs(spark, rows))) == [(1, "Home | About\none"), (2, "two\n \n"), (3, "Home | Abouts"), (4, " \n}")]


def test_buckets_that_one_line_joins_need_no_further_pairs(spark, monkeypatch):
    head, tail = "the very same beginning of a line ", " and the very same end of it all"
    rows = [(i, f"{head}{chr(97 + i % 26)}{chr(97 + i // 26)}{tail}") for i in range(60)]
    monkeypatch.setattr(lines, "mask_keys", None)
    rule = lines.LineRule(pair_limit=4)
    assert cleaned(lines.dedup_lines(docs(spark, rows), rule)) == brute(rows, rule)


def test_hard_rows(spark):
    line = "a line of more than thirty-two characters, often seen"
    rows = [*HARD, (11, f"{line}\n\n{line}\nshort\n"), (12, line), (13, line + "!"), (None, line), (14, "\n\n")]
    table = docs(spark, rows)
    out = lines.dedup_lines(table)
    assert out.columns == [*table.columns, "n_lines", "n_dropped"]
    found = cleaned(out)
    assert len(found) == len(rows)
    texts = dict(x for x in found if x[0] is not None)
    assert texts[11] == f"{line}\n\nshort\n" and texts[12] == "" and texts[13] == "" and (None, line) in found
    assert texts[7] == rows[7][1] and texts[8] == "" and texts[1] is None and texts[14] == "\n\n"
    counts = {r.doc_id: (r.n_lines, r.n_dropped) for r in out.collect()}
    assert counts[11] == (5, 1) and counts[1] == (0, 0) and counts[2] == (1, 0)
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_cells_meet_within_edits_and_are_few(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abcdef012xyz ") for _ in range(rng.randrange(32, 60)))
        pairs.append((a, mutated(rng, a, 2, "abcdef012xyz ")))
    for edits in (2, 3):
        cells = spark.createDataFrame(pairs, "a string, b string").select(lines._cells(F.col("a"), edits).alias("x"), lines._cells(F.col("b"), edits).alias("y")).collect()
        assert all(set(r.x) & set(r.y) for r in cells)
        # every text stood in eight cells
        assert sum(len(r.x) for r in cells) < 6 * len(cells)
