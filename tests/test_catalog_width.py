from pyspark.sql import functions as F

from tidemark.operators import catalog

HEX = "0123456789abcdef" * 4


def test_digests_are_packed_without_loss(spark):
    texts = [HEX, HEX.upper(), HEX[:-1], HEX + "0", "g" * 64, "", "other", HEX[:62] + "é", None]
    rows = spark.createDataFrame([(t,) for t in texts], "d string").select("d", catalog._packed("d").alias("p")).collect()
    packed = {r.d: None if r.p is None else bytes(r.p) for r in rows}
    assert packed[None] is None and len(packed[HEX]) == 33
    assert len(set(packed.values())) == len(texts)


def test_states_compare_whole_digests_and_share_the_selections(spark):
    columns = catalog.ENTRY_SCHEMA
    rows = [("v", k, f"e{k}", f"k{k}", sha, f"/d/{k}", 1, [], "x", "p", "1") for k, sha in enumerate([HEX, HEX, "other", HEX])]
    entries = spark.createDataFrame(rows, columns)
    files = spark.createDataFrame([("/d/0", HEX), ("/d/1", HEX.upper()), ("/d/2", "other")], "uri string, sha256 string")
    states = catalog.entry_states(entries, entries.select("video_id", "revision", "key", "entry_id"), files)
    found = {r.entry_id: (r.state, r.intact, r.active) for r in states.collect()}
    assert found == {"e0": ("available", True, True), "e1": ("available", False, True), "e2": ("available", True, True), "e3": ("missing", None, True)}
    optimized = states.select("entry_id", "intact")._jdf.queryExecution().optimizedPlan().toString()
    # the join on paths moves the packed digests alone
    join = optimized[optimized.index("_held"):]
    assert "_content" in join and "file_sha256" not in optimized


def test_reuse_takes_the_newest_entry(spark):
    rows = [("v", 2, "a", "k", HEX, "/d/a", 1, ["z"], None, "p", "1"), ("v", 2, "b", "k", HEX, "/d/b", 1, ["z"], None, "p", "1"), ("v", 1, "c", "k", HEX, "/d/c", 1, ["z"], None, "p", "1")]
    states = spark.createDataFrame(rows, catalog.ENTRY_SCHEMA).withColumns({"state": F.lit("available"), "intact": F.lit(True)})
    requests = spark.createDataFrame([("r", "v", "k", None, ["z"])], "request_id string, video_id string, key string, derivation_key string, dependency_entry_ids array<string>")
    assert [tuple(r) for r in catalog.find_reusable(states, requests).collect()] == [("r", "v", "k", "b", 2)]


def test_registrations_are_decided_behind_the_last_shuffle(spark):
    rows = [("v", 1, "a", "k", HEX, "/d/a", 1, [], "x", "p", "1")]
    entries = spark.createDataFrame(rows, catalog.ENTRY_SCHEMA)
    batch = entries.drop("revision", "entry_id").withColumns({"request_id": F.lit("r"), "activate": F.lit(True)})
    files = spark.createDataFrame([("/d/a", HEX)], "uri string, sha256 string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        decided = catalog.register(batch, entries, entries.select("video_id", "revision", "key", "entry_id"), files=files)["decided"]
        plan = decided._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    above = plan[: plan.index("SortMergeJoin")]
    assert "Window" in above and "Exchange" not in above
    assert [r.outcome for r in decided.collect()] == ["unchanged"]
