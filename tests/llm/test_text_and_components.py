import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import Union
from tidemark.llm import bytetext
from tidemark.llm.components import connected_components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=12))
def test_runs_are_the_words_of_each_text(texts):
    data, offsets = bytetext.flat(pa.array(texts, pa.string()))
    spaces = np.zeros(256, bool)
    spaces[[32, 9, 10, 11, 12, 13]] = True
    starts, ends = bytetext.runs(~spaces[data], offsets)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [w for t in texts for w in t.encode().split()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=12))
def test_equal_spans_have_equal_hashes_wherever_they_stand(texts):
    raw = [t.encode() for t in texts] * 2
    ends = np.cumsum([len(t) for t in raw])
    hashes = bytetext.span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends, bytetext.Powers()).tolist()
    assert len(dict(zip(raw, hashes))) == len(set(hashes))
    assert hashes[: len(texts)] == hashes[len(texts) :]


def test_slices_cover_all_rows_of_sliced_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * k for k in (5, 0, 900, 3, 3, 3)])], ["text"]).slice(1)
    parts = list(bytetext.slices(iter([batch]), limit=7))
    assert [p.column("text").to_pylist() for p in parts] == [[""], ["a" * 900], ["aaa", "aaa"], ["aaa"]]
    assert [x for p in parts for x in bytetext.as_bytes(p.column("text"))] == [b"", b"a" * 900, b"aaa", b"aaa", b"aaa"]


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(80)] + [(3, 3), (9, 8), (9, 8)]
    groups = Union({x for e in edges for x in e})
    for a, b in edges:
        groups.join(a, b)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found.get(x, x) == groups.find(x) for x in groups.up)
    assert all(k != v for k, v in found.items())


def test_no_edges_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rounds_on_few_edges_have_few_tasks(spark, monkeypatch):
    # as on a cluster that keeps to its number of partitions
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("components", "")
    try:
        found = {r.node: r.component for r in connected_components(edges).collect()}
    finally:
        context.setJobGroup("", "")
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found == {k: 0 for k in range(1, 41)}
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("components")]
    stages = [tracker.getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
    tasks = sum(s.numCompletedTasks for s in stages if s)
    assert tasks < 48 * 30
