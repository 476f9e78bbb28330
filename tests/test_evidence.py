"""Search, fusion of two lists, catalog, verification and ledgers."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import derivation_key, redact_map
from tidemark.functions.text import collapse_whitespace, normalize_compat, plain_text, query_terms, text_similarity, tokenize
from tidemark.functions.vectors import normalize_vector, unit_query
from tidemark.operators import catalog, indexing, ledger, retrieval, verification
from tidemark.udfs.backends import HashingEmbedder, embed_documents

DOCS = "item_id string, text string, start_ms long, end_ms long, source_ids array<string>, tags array<string>"


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Hello, World_1 x2", ["hello", "world_1", "x2"]),
        ("ärger naïve", ["rger", "na", "ve"]),
        ("开door门吧 K", ["开", "door", "门", "吧", "k", "开门", "门吧"]),
        ("中", ["中"]),
        ("K Kelvin", ["kelvin"]),
        ("", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, text, tokenize) == tokens
    assert query_terms(text) == tokens


def test_text_helpers(spark):
    assert one(spark, "<b>Hello</b>&amp;  world\n", plain_text) == "Hello& world"
    assert one(spark, "Ｆｕｌｌ　ﬁt  ", normalize_compat) == "Full fit"
    assert one(spark, " a  b\x1c c ", collapse_whitespace) == "a b c"
    ratio = spark.createDataFrame([("Straße", "STRASSE")], "a string, b string").select(text_similarity("a", "b").alias("x")).first().x
    assert ratio == 1.0


def bm25(docs, query):
    terms, k1, b = Counter(query_terms(query)), 1.5, 0.75
    counts = {d[0]: Counter(query_terms(d[1])) for d in docs}
    n, average = len(docs), sum(sum(c.values()) for c in counts.values()) / len(docs) or 1.0
    scores = {}
    for item, c in counts.items():
        score = 0.0
        for term, weight in terms.items():
            if c[term]:
                df = sum(1 for other in counts.values() if other[term])
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                score += weight * idf * c[term] * (k1 + 1) / (c[term] + k1 * (1 - b + b * sum(c.values()) / average))
        if score > 0:
            scores[item] = score
    return scores


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(9)
    words = ["door", "opens", "red", "car", "street", "开", "门"]
    return [
        (f"d{n:02d}", " ".join(rng.choices(words, k=rng.randrange(1, 12))), n * 10, n * 10 + 5, [f"d{n:02d}", f"c{n % 4}"], ["en" if n % 3 else "de", "asr"])
        for n in range(40)
    ]


@pytest.mark.parametrize("prepared", [False, True])
def test_bm25_scores(spark, documents, prepared):
    df = spark.createDataFrame(documents, DOCS)
    index = indexing.text_index(df, ["item_id"]) if prepared else df
    got = retrieval.bm25_search(index, "door opens door 开门", top_k=100).orderBy("rank").collect()
    expected = bm25(documents, "door opens door 开门")
    assert {r.item_id for r in got} == set(expected)
    assert all(abs(r.score - expected[r.item_id]) < 1e-9 for r in got)
    start = {d[0]: d[2] for d in documents}
    assert [r.item_id for r in got] == sorted(expected, key=lambda i: (-round(expected[i], 12), start[i]))


def test_bm25_statistics_follow_the_filter(spark, documents):
    where = retrieval.SearchFilter(within=(0, 200), any_source_ids=("c1", "c2"), all_tags=("en", "asr"))
    kept = [d for d in documents if d[2] < 200 and 0 < d[3] and {"c1", "c2"} & set(d[4]) and "en" in d[5]]
    got = {r.item_id: r.score for r in retrieval.bm25_search(spark.createDataFrame(documents, DOCS), "red car", where=where).collect()}
    expected = bm25(kept, "red car")
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-9 for i in got)


def test_bm25_without_terms_or_matches(spark, documents):
    df = spark.createDataFrame(documents, DOCS)
    assert retrieval.bm25_search(df, "?!").count() == 0
    assert retrieval.bm25_search(df, "absent").count() == 0
    with pytest.raises(ValueError):
        retrieval.bm25_search(df, " ")


def test_dense_search_keeps_zero_scores_and_checks_vectors(spark):
    rows = [("a", [1.0, 0.0], 0, 1), ("b", [0.0, 2.0], 1, 2), ("c", [-1.0, 0.0], 2, 3)]
    df = spark.createDataFrame(rows, "item_id string, v array<float>, start_ms long, end_ms long")
    unit = df.withColumn("vector", normalize_vector(F.col("v"), 2))
    assert [r.item_id for r in retrieval.dense_search(unit, [3.0, 0.0], 2).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        unit_query([0.0, 0.0], 2)
    with pytest.raises(Exception):
        df.select(normalize_vector(F.col("v"), 3)).collect()


HITS = ("video_id string, modality string, rank int, source_ids array<string>, start_ms long, end_ms long, text string, "
        "confidence double, scores map<string,double>")


def test_hybrid_search(spark):
    sparse = [("v", "transcript", 1, ["c1", "s1"], 0, 5, "one", None, {"bm25": 2.0}), ("v", "transcript", 2, ["c2"], 5, 9, None, None, {"bm25": 1.0})]
    dense = [("v", "transcript", 1, ["c2", "s9"], 5, 9, "two", 0.5, {"cosine": 0.9, "bm25": 7.0}), ("v", "transcript", 2, ["c3"], 9, 12, "three", None, {"cosine": 0.8})]
    got = retrieval.hybrid_search(spark.createDataFrame(sparse, HITS), spark.createDataFrame(dense, HITS)).orderBy("rank").collect()
    assert [r.source_id for r in got] == ["c2", "c1", "c3"]
    assert (got[0].text, got[0].source_ids, dict(got[0].scores)) == ("two", ["c2", "s9"], {"bm25": 7.0, "cosine": 0.9})
    assert math.isclose(got[0].hybrid_rrf, 1 / 62 + 1 / 61)


def test_embedding_back_end(spark):
    df = spark.createDataFrame([("a", "red car"), ("b", "blue door")], "item_id string, text string")
    got = {r.item_id: r.vector for r in embed_documents(df, lambda: HashingEmbedder(16), 16).collect()}
    assert all(math.isclose(sum(x * x for x in v), 1.0, rel_tol=1e-6) for v in got.values())


ENTRIES = catalog.ENTRY_SCHEMA


def entry(revision, name, key, deps=(), sha=None):
    return ("v", revision, name, key, sha or name, f"/root/{name}", 1, list(deps), "k", "p", "1")


def test_staleness_and_reactivation(spark):
    entries = spark.createDataFrame(
        [entry(1, "src", "source"), entry(2, "t1", "transcript", ["src"]), entry(3, "i1", "index", ["t1"]), entry(4, "t2", "transcript", ["src"])], ENTRIES
    )
    selections = [("v", 1, "source", "src"), ("v", 2, "transcript", "t1"), ("v", 3, "index", "i1"), ("v", 4, "transcript", "t2")]
    stored = spark.createDataFrame(selections, catalog.SELECTION_SCHEMA)

    def states(chosen):
        return {r.entry_id: r.state for r in catalog.audit(catalog.entry_states(entries, chosen)).collect()}

    assert states(stored) == {"src": "available", "t1": "superseded", "i1": "stale", "t2": "available"}
    back = catalog.activate(spark.createDataFrame([("v", "transcript", "t1")], "video_id string, key string, entry_id string"), entries, stored)
    assert [(r.revision, r.entry_id) for r in back.collect()] == [(5, "t1")]
    assert states(stored.unionByName(back))["i1"] == "available"


def test_files_decide_missing_corrupt_and_reuse(spark):
    entries = spark.createDataFrame([entry(1, "a", "k1"), entry(2, "b", "k2"), entry(3, "c", "k3"), entry(4, "d", "k4")], ENTRIES)
    selections = entries.select("video_id", "revision", "key", "entry_id")
    files = spark.createDataFrame([("/root/a", "a"), ("/root/b", "changed"), ("/root/d", "d")], "uri string, sha256 string")
    states = catalog.entry_states(entries, selections, files)
    assert {r.entry_id: r.issue for r in catalog.audit(states, deep=True).collect()} == {"a": None, "b": "hash_mismatch", "c": "missing_file", "d": None}
    report = catalog.audit_report(catalog.audit(states, deep=True)).first()
    assert (report.available, report.corrupt, report.missing, report.valid) == (2, 1, 1, False)
    asked = entries.select(F.col("entry_id").alias("request_id"), "video_id", "key", "derivation_key", "dependency_entry_ids")
    assert {r.request_id for r in catalog.find_reusable(states, asked).collect()} == {"a", "d"}
    outside = catalog.entry_states(entries, selections, files, allowed_roots=["/other"])
    assert {r.state for r in outside.collect()} == {"corrupt"}


def test_register_batch(spark):
    entries = spark.createDataFrame([entry(1, "src", "source"), entry(2, "t1", "transcript", ["src"], "aa"), entry(3, "t2", "transcript", ["src"], "bb")], ENTRIES)
    selections = entries.select("video_id", "revision", "key", "entry_id")

    def ask(name, sha, deps, activate=True, video="v"):
        return (name, video, "transcript", sha, "/x", 1, deps, "k", "p", "1", activate)

    columns = (
        "request_id string, video_id string, key string, content_sha256 string, uri string, size_bytes long, dependency_entry_ids array<string>, "
        "derivation_key string, producer_name string, producer_version string, activate boolean"
    )
    asked = [ask("same", "bb", ["src"]), ask("older", "aa", ["src"]), ask("new", "cc", ["src"]), ask("orphan", "dd", ["nope"]), ask("lost", "ee", [], True, "w")]
    batch = spark.createDataFrame([(*r, k) for k, r in enumerate(asked)], columns + ", request_no long")
    planned = catalog.register(batch, entries, selections)
    assert {r.request_id: r.revision for r in planned["decided"].collect()} == {"same": 3, "older": 4, "new": 5, "orphan": 5, "lost": None}
    assert [(r.revision, r.entry_id) for r in planned["selections"].orderBy("revision").collect()][0] == (4, "t1")
    assert {r.request_id: r.outcome for r in planned["decided"].collect()} == {
        "same": "unchanged", "older": "reactivated", "new": "registered", "orphan": "dependency_not_found", "lost": "video_not_found"}
    assert [r.content_sha256 for r in planned["entries"].collect()] == ["cc"]
    stale = spark.createDataFrame([("v", 2)], "video_id string, expected_revision long")
    conflicted = catalog.register(batch.where("video_id = 'v'"), entries, selections, stale)["decided"]
    assert {r.outcome for r in conflicted.collect()} == {"revision_conflict"}


def test_requests_of_one_video_take_effect_in_order(spark):
    plain = entry(1, "src", "source")
    unknown = (*entry(2, "t1", "transcript", ["src"], "aa")[:8], None, *entry(2, "t1", "transcript", ["src"], "aa")[9:])
    entries = spark.createDataFrame([plain, unknown], ENTRIES)
    selections = entries.select("video_id", "revision", "key", "entry_id")
    columns = (
        "request_id string, video_id string, key string, content_sha256 string, uri string, size_bytes long, dependency_entry_ids array<string>, "
        "derivation_key string, producer_name string, producer_version string, activate boolean"
    )
    row = entries.where("entry_id = 't1'").first()

    def ask(name, sha, activate=True, uri="/x"):
        return (name, "v", "transcript", sha, uri, 1, ["src"], None, row.producer_name, row.producer_version, activate)

    asked = [
        ask("a", "aa"), ask("b", "new"), ask("c", "new"), ask("d", "aa"), ask("e", "later", False), ask("f", "later"), ask("g", "later"), ask("h", "bad", uri="/y"),
    ]
    files = spark.createDataFrame([("/y", "else")], "uri string, sha256 string")
    planned = catalog.register(spark.createDataFrame(asked, columns), entries, selections, files=files)
    rows = {r.request_id: r for r in planned["decided"].collect()}
    assert [rows[k].outcome for k in "abcdefgh"] == ["unchanged", "registered", "unchanged", "reactivated", "registered", "reactivated", "unchanged", "hash_mismatch"]
    assert [rows[k].revision for k in "abcdefg"] == [2, 3, 3, 4, 5, 6, 6]
    assert rows["b"].entry_id == rows["c"].entry_id and rows["e"].entry_id == rows["f"].entry_id and rows["d"].entry_id == "t1"
    assert sorted(r.revision for r in planned["entries"].collect()) == [3, 5]
    assert [r.revision for r in planned["selections"].orderBy("revision").collect()] == [3, 4, 6]
    reusable = catalog.find_reusable(
        catalog.entry_states(entries, selections), entries.select(F.col("entry_id").alias("request_id"), "video_id", "key", "derivation_key", "dependency_entry_ids")
    )
    assert {(r.request_id, r.entry_id) for r in reusable.collect()} == {("src", "src"), ("t1", "t1")}


def test_activations_raise_the_revision_one_by_one(spark):
    entries = spark.createDataFrame([entry(1, "a1", "a"), entry(2, "a2", "a"), entry(3, "b1", "b"), entry(4, "b2", "b")], ENTRIES)
    selections = entries.select("video_id", "revision", "key", "entry_id")
    choices = spark.createDataFrame([("v", "b", "b1", 0), ("v", "a", "a1", 1), ("v", "a", "a2", 2), ("v", "a", "a2", 3), ("v", "a", "b1", 4)], "video_id string, key string, entry_id string, choice_no int")
    rows = catalog.activate(choices, entries, selections).orderBy("revision").collect()
    assert [(r.revision, r.entry_id) for r in rows] == [(5, "b1"), (6, "a1"), (7, "a2")]


def test_catalog_store_round_trip(spark, tmp_path):
    from tidemark.sources.catalog_store import CatalogStore, RevisionConflict

    store = CatalogStore(spark, str(tmp_path)).initialise()
    asset = spark.createDataFrame([("v", "/root/v.mp4", "sha", 9)], "video_id string, uri string, sha256 string, size_bytes long")
    assert store.create_videos(asset).first().outcome == "created"
    assert store.create_videos(asset).first().outcome == "unchanged"
    moved = asset.withColumn("uri", F.lit("/root/other.mp4"))
    assert store.create_videos(moved).first().outcome == "video_already_registered"
    source = store.entries.first().entry_id
    batch = spark.createDataFrame(
        [("r1", "v", "manifest:shots:primary", "h", "/root/s", 1, [source], "k", "p", "1", True)],
        "request_id string, video_id string, key string, content_sha256 string, uri string, size_bytes long, dependency_entry_ids array<string>, "
        "derivation_key string, producer_name string, producer_version string, activate boolean",
    )
    assert store.register(batch).first().outcome == "registered"
    assert store.register(batch).first().outcome == "unchanged"
    assert store.entries.count() == 2 and store.states().where("active").count() == 2
    with pytest.raises(RevisionConflict):
        store.register(batch, spark.createDataFrame([("v", 1)], "video_id string, expected_revision long"))


def test_derivation_key_ignores_parameter_order():
    assert derivation_key("p", "1", {"a": 1, "b": 2}) == derivation_key("p", "1", {"b": 2, "a": 1})
    assert derivation_key("p", "1", {"a": 1}) != derivation_key("p", "2", {"a": 1})


EVIDENCE = "answer_id string, evidence_id string, video_id string, modality string, start_ms long, end_ms long, text string"
CLAIMS = "answer_id string, claim_no int, evidence_ids array<string>, confidence double"


@pytest.mark.parametrize(
    "intent, ids, coverage, status, note",
    [
        ("local_event", ["e1"], 0.0, "sufficient", ""),
        ("local_event", ["e1", "ghost"], 0.0, "insufficient", "unknown evidence: ghost"),
        ("local_event", [], 0.0, "insufficient", "no supporting evidence"),
        ("visual", ["e1"], 0.0, "insufficient", "visual"),
        ("visual", ["e1", "e2"], 0.0, "sufficient", ""),
        ("screen_text", ["e2"], 0.0, "insufficient", "OCR"),
        ("causal", ["e1", "e1"], 0.0, "insufficient", "corroborating"),
        ("global", ["e1"], 0.5, "insufficient", "0.50 is below the required 0.70"),
        ("global", ["e1"], 0.7, "sufficient", ""),
        ("local_event", ["e3"], 0.0, "insufficient", "another video: e3"),
        ("metadata", [], 0.0, "sufficient", ""),
    ],
)
def test_verification(spark, intent, ids, coverage, status, note):
    evidence = spark.createDataFrame(
        [("a", "e1", "v", "transcript", 0, 9, "x" * 600), ("a", "e2", "v", "frame", 0, 9, "y"), ("a", "e3", "w", "transcript", 0, 9, "z")], EVIDENCE
    )
    answers = spark.createDataFrame([("a", "v", intent)], "answer_id string, video_id string, intent string")
    claims = spark.createDataFrame([("a", 1, ids, 0.5), ("a", 2, ids, None)], CLAIMS)
    covered = spark.createDataFrame([("a", coverage)], "answer_id string, coverage double")
    reports = verification.verify_answers(answers, claims, evidence, covered)
    report = reports.first()
    assert report.status == status and report.confidence == 0.5
    assert note in " ".join(report.missing_evidence)
    assert (report.recommended_actions == ["answer"]) == (status == "sufficient")
    for cited in verification.citations_of(reports, evidence).collect():
        assert len(cited.excerpt) <= 500


def test_conflicts_win(spark):
    evidence = spark.createDataFrame([("a", "e1", "v", "transcript", 0, 9, "x")], EVIDENCE)
    answers = spark.createDataFrame([("a", "v", "local_event")], "answer_id string, video_id string, intent string")
    claims = spark.createDataFrame([("a", 1, ["e1"], 0.5)], CLAIMS)
    conflicts = spark.createDataFrame([("a", 1)], "answer_id string, n_conflicts int")
    report = verification.verify_answers(answers, claims, evidence, conflicts=conflicts).first()
    assert (report.status, report.cross_modal_consistency) == ("conflicting", 0.0)
    assert report.recommended_actions == ["inspect_adjacent_context", "find_second_evidence"]


def test_streaks_across_shards(spark, cut_policy):
    rng = random.Random(2)
    calls = [("r", n, rng.random() < 0.2) for n in range(60)]
    df = spark.createDataFrame(calls, "run_id string, call_no long, gained boolean")
    got = {r.call_no: r.streak for r in ledger.no_gain_streaks(df, policy=cut_policy).collect()}
    streak = 0
    for _, number, gained in calls:
        streak = 0 if gained else streak + 1
        assert got[number] == streak


def test_new_beyond_top_k_counts_as_reused(spark):
    rows = [("r", 1, n, f"c{n}") for n in range(1, 5)] + [("r", 2, 1, "c1"), ("r", 2, 2, "c9")]
    df = spark.createDataFrame(rows, "run_id string, call_no long, rank long, candidate_id string")
    got = {(r.call_no, r.candidate_id): r.status for r in ledger.split_new_and_reused(df, 2).collect()}
    assert got == {(1, "c1"): "new", (1, "c2"): "new", (1, "c3"): "reused", (1, "c4"): "reused", (2, "c1"): "reused", (2, "c9"): "new"}


def test_redaction(spark):
    df = spark.createDataFrame([({"API-Key": "a", "db_password": "b", "Authorization": "c", "tokens": "d"},)], "p map<string,string>")
    assert df.select(redact_map(F.col("p")).alias("p")).first().p == {
        "API-Key": "[REDACTED]", "db_password": "[REDACTED]", "Authorization": "[REDACTED]", "tokens": "d"}


def test_hashes_are_compared_before_the_entries_meet_their_states(spark):
    from tidemark.operators import catalog

    rows = [("v", n, f"e{n}", f"k{n}", f"h{n}", f"/d/{n}", 1, [], None, "p", "1") for n in range(3)]
    entries = spark.createDataFrame(rows, catalog.ENTRY_SCHEMA)
    files = spark.createDataFrame([("/d/0", "h0"), ("/d/1", "other")], "uri string, sha256 string")
    states = catalog.entry_states(entries, entries.select("video_id", "revision", "key", "entry_id"), files, ["/d"])
    assert {r.entry_id: (r.state, r.intact) for r in states.collect()} == {"e0": ("available", True), "e1": ("available", False), "e2": ("missing", None)}
    issues = {r.entry_id: r.issue for r in catalog.audit(states, deep=True).collect()}
    assert issues == {"e0": None, "e1": "hash_mismatch", "e2": "missing_file"}
