"""Search of the stored index: the hits of a search over texts, with fewer blocks opened than there are."""

from __future__ import annotations

import os
import random

import pytest

from tidemark.operators import retrieval
from tidemark.sources import inverted_index

DOCS = "item_id string, start_ms long, end_ms long, text string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(4)
    common, rare = ["the", "of", "and", "to", "in"], [f"r{n}" for n in range(40)]
    rows = []
    for n in range(900):
        words = rng.choices(common, k=rng.choice([1, 5, 40, 200]))
        if rng.random() < 0.1:
            words += rng.choices(rare, k=rng.choice([1, 4]))
        rows.append((f"d{n}", n * 10, n * 10 + 5, " ".join(words)))
    rows += [("empty", 1, 2, ""), ("none", 1, 2, None), ("twin a", 5, 6, "r1 r1"), ("twin b", 5, 6, "r1 r1")]
    documents = spark.createDataFrame(rows, DOCS).repartition(3)
    path = str(tmp_path_factory.mktemp("index") / "texts")
    inverted_index.write_inverted_index(documents, path)
    return documents, path


@pytest.mark.parametrize("query, top_k", [("r1 the", 5), ("the of and", 12), ("r3 r5 r7 r9", 3), ("the the r2", 1), ("r4", 500), ("nothing like it", 4), ("?!", 2)])
def test_hits_are_those_of_a_search_over_texts(spark, stored, query, top_k):
    documents, path = stored
    hits, cost = inverted_index.search_index(spark, path, query, top_k, probe_ranges=1)
    rows = lambda df: [(r.rank, r.item_id, r.score) for r in df.orderBy("rank").collect()]
    got, expected = rows(hits), rows(retrieval.bm25_search(documents.fillna({"text": ""}), query, top_k))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], rel=1e-12)
    assert cost.opened <= cost.blocks


def test_blocks_that_cannot_be_among_the_best_stay_closed(spark, stored):
    _, path = stored
    _, cost = inverted_index.search_index(spark, path, "r1 the of", 3, probe_ranges=2)
    assert 0 < cost.opened < cost.blocks


def test_only_the_terms_of_the_query_are_read(spark, stored):
    _, path = stored
    hits, cost = inverted_index.search_index(spark, path, "r1", 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    assert cost.blocks == spark.read.parquet(f"{path}/blocks").where("term = 'r1'").count()


def test_arguments(spark, stored):
    with pytest.raises(ValueError):
        inverted_index.search_index(spark, stored[1], " ", 3)
    with pytest.raises(ValueError):
        inverted_index.search_index(spark, stored[1], "a", 0)


def test_documents_are_written_once_and_postings_are_two_numbers(spark, stored):
    documents, path = stored
    blocks = spark.read.parquet(f"{path}/blocks")
    types = dict(blocks.dtypes)
    assert (types["places"], types["tfs"]) == ("array<smallint>", "array<int>")
    held = blocks.where("folder = -1").selectExpr("explode(documents) AS d").select("d.item_id")
    assert sorted(r.item_id for r in held.collect()) == sorted(r.item_id for r in documents.collect())
    assert not [name for name in os.listdir(path) if name == "texts"]
