"""Commits of the catalog: races, half-written appends, compaction; and the checks of a typed load."""

from __future__ import annotations

import threading

import pytest

from tidemark.operators import catalog
from tidemark.sources.catalog_store import CatalogStore, RevisionConflict
from tidemark.sources.commit_log import CommitConflict, CommitLog

ASSET = "video_id string, uri string, sha256 string, size_bytes long"
BATCH = (
    "request_id string, video_id string, key string, content_sha256 string, uri string, size_bytes long, dependency_entry_ids array<string>, "
    "derivation_key string, producer_name string, producer_version string, activate boolean"
)


def request(spark, name, source, video="v"):
    return spark.createDataFrame([(name, video, f"manifest:{name}:primary", f"h-{name}", f"/root/{name}", 1, [source], f"k-{name}", "p", "1", True)], BATCH)


@pytest.fixture
def store(spark, tmp_path):
    made = CatalogStore(spark, str(tmp_path)).initialise()
    made.create_videos(spark.createDataFrame([("v", "/root/v.mp4", "sha", 9)], ASSET))
    return made


def both_at_once(store, calls):
    """Run the calls so that both have read the catalog before either commits."""
    barrier, outcomes = threading.Barrier(len(calls)), [None] * len(calls)
    commit, first = CommitLog.commit, threading.local()

    def waiting(self, rows, after, replaces=False):
        if not getattr(first, "done", False):
            first.done = True
            barrier.wait(60)
        return commit(self, rows, after, replaces)

    def run(k):
        try:
            outcomes[k] = calls[k]().first().outcome
        except Exception as error:
            outcomes[k] = type(error).__name__

    CommitLog.commit = waiting
    try:
        threads = [threading.Thread(target=run, args=(k,)) for k in range(len(calls))]
        [t.start() for t in threads]
        [t.join(120) for t in threads]
    finally:
        CommitLog.commit = commit
    return sorted(outcomes)


def test_of_two_writers_with_one_expectation_one_fails(spark, store):
    source = store.entries.first().entry_id
    expected = spark.createDataFrame([("v", 1)], "video_id string, expected_revision long")
    calls = [lambda name=name: store.register(request(spark, name, source), expected) for name in ("a", "b")]
    assert both_at_once(store, calls) == ["RevisionConflict", "registered"]
    assert store.entries.count() == 2 and store.log.versions() == [0, 1, 2]


def test_two_writers_without_expectations_follow_each_other(spark, store):
    source = store.entries.first().entry_id
    assert both_at_once(store, [lambda name=name: store.register(request(spark, name, source)) for name in ("a", "b")]) == ["registered", "registered"]
    assert sorted(r.revision for r in store.entries.collect()) == [1, 2, 3]


def test_what_is_not_committed_is_not_read(spark, store, tmp_path):
    entries = store.entries
    entries.write.parquet(str(tmp_path / "data" / "entries-torn"))
    assert store.entries.count() == 1
    with pytest.raises(CommitConflict):
        store.log.commit({"entries": entries}, after=0)
    assert store.entries.count() == 1
    assert len(list((tmp_path / "data").glob("entries-*"))) == 2


def test_old_versions_stay_readable_and_compaction_changes_nothing(spark, store):
    source = store.entries.first().entry_id
    store.register(request(spark, "a", source))
    before = sorted(map(str, store.entries.collect()))
    store.compact()
    assert sorted(map(str, store.entries.collect())) == before and store.log.read("entries", 1).count() == 1
    assert [len(p) for p in store.log.folders(store.log.head()).values()] == [1, 1]
    assert store.register(request(spark, "a", source)).first().outcome == "unchanged"
    stale = spark.createDataFrame([("v", 1)], "video_id string, expected_revision long")
    with pytest.raises(RevisionConflict):
        store.register(request(spark, "c", source), stale)


def test_typed_loads(spark):
    names = ["good", "kind", "gone", "changed", "silent", "mixed", "foreign"]
    entries = spark.createDataFrame([("v", 1, f"e-{n}", f"manifest:shots:{n}", f"H-{n}".upper(), f"/{n}", 1, [], "d", "p", "1") for n in names], catalog.ENTRY_SCHEMA)
    selections = entries.select("video_id", "revision", "key", "entry_id")
    files = spark.createDataFrame([(f"/{n}", "other" if n == "changed" else f"h-{n}") for n in names if n != "gone"], "uri string, sha256 string")
    contents = spark.createDataFrame(
        [(f"/{n}", "w" if n == "foreign" else "v", "frames" if n == "mixed" else "shots") for n in names if n != "silent"], "uri string, content_video_id string, content_kind string"
    )
    wanted = spark.createDataFrame([("v", f"manifest:shots:{n}", "frames" if n == "kind" else "shots") for n in [*names, "unknown"]], "video_id string, key string, expected_kind string")
    found = {r.key.split(":")[2]: r.outcome for r in catalog.check_loads(wanted, entries, selections, files, contents).collect()}
    assert found == {
        "good": "loaded", "kind": "type_mismatch", "gone": "missing", "changed": "hash_mismatch", "silent": "corrupt",
        "mixed": "corrupt", "foreign": "identity_mismatch", "unknown": "not_found",
    }
