"""Catalog resolution, staleness, reuse, audit and registration over orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import catalog_key_name
from tidemark.operators import catalog
from tidemark.queries import query
from tidemark.session import read_table
from tidemark.sources.workload import order_catalog

_CAT = """base AS (
  SELECT CAST(o_custkey AS VARCHAR) AS video_id, o_orderkey AS revision, 'entry_' || o_orderkey AS entry_id,
         'manifest:' || o_orderpriority || ':primary' AS key, o_orderstatus AS derivation_key, o_totalprice,
         min(o_orderkey) OVER (PARTITION BY o_custkey) AS root_no
  FROM orders),
entries AS (SELECT *, CASE WHEN revision = root_no THEN NULL ELSE 'entry_' || root_no END AS dep FROM base),
active AS (SELECT video_id, key, max_by(entry_id, revision) AS entry_id, max(revision) AS revision FROM entries GROUP BY video_id, key),
st AS (
  SELECT e.*, a.entry_id IS NOT NULL AS active,
         CASE WHEN derivation_key = 'P' THEN 'missing' WHEN dep IS NOT NULL AND d.entry_id IS NULL THEN 'stale' ELSE 'available' END AS state,
         derivation_key <> 'P' AND o_totalprice >= 50000 AS intact
  FROM entries e LEFT JOIN active a ON a.video_id = e.video_id AND a.entry_id = e.entry_id
  LEFT JOIN active d ON d.video_id = e.video_id AND d.entry_id = e.dep)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, selections, files = order_catalog(spark, sf_dir)
    return catalog.entry_states(entries, selections, files, allowed_roots=["/data/artifacts"])


@query(f"WITH {_CAT} SELECT video_id, key, entry_id, revision FROM active")
def catalog_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, selections, _ = order_catalog(spark, sf_dir)
    return catalog.active_selections(selections)


@query(f"WITH {_CAT} SELECT video_id, revision, entry_id FROM entries WHERE key = 'manifest:2-HIGH:primary'")
def catalog_entries_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _, _ = order_catalog(spark, sf_dir)
    return catalog.list_entries(entries, "manifest:2-HIGH:primary").select("video_id", "revision", "entry_id")


@query(f"WITH {_CAT} SELECT video_id, entry_id, dep AS dependency FROM st WHERE dep IS NOT NULL AND dep NOT IN (SELECT entry_id FROM active)")
def catalog_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, selections, _ = order_catalog(spark, sf_dir)
    return catalog.stale_dependencies(entries, selections)


@query(f"""WITH {_CAT} SELECT video_id, key, entry_id, state,
CASE state WHEN 'stale' THEN 'stale_resource' WHEN 'missing' THEN 'resource_missing' ELSE '' END AS error_code FROM st WHERE active""")
def catalog_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = catalog.resolve(_states(spark, sf_dir))
    return resolved.select(
        "video_id", "key", "entry_id", "state", F.coalesce("error_code", F.lit("")).alias("error_code")
    )


@query(f"""WITH {_CAT}, u AS (SELECT video_id, key, derivation_key, dep, max_by(entry_id, revision) AS entry_id, max(revision) AS revision
  FROM st WHERE state = 'available' AND intact GROUP BY video_id, key, derivation_key, dep)
SELECT e.entry_id AS request_id, e.video_id, e.key, u.entry_id, u.revision
FROM entries e JOIN u ON u.video_id = e.video_id AND u.key = e.key AND u.derivation_key = e.derivation_key AND u.dep IS NOT DISTINCT FROM e.dep""")
def catalog_reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, selections, files = order_catalog(spark, sf_dir)
    states = catalog.entry_states(entries, selections, files)
    requests = entries.select(
        F.col("entry_id").alias("request_id"), "video_id", "key", "derivation_key", "dependency_entry_ids"
    )
    return catalog.find_reusable(states, requests)


@query(f"""WITH {_CAT} SELECT video_id, entry_id, CASE WHEN NOT active THEN 'superseded' WHEN state = 'missing' THEN 'missing'
  WHEN NOT intact THEN 'corrupt' ELSE state END AS state,
  CASE WHEN NOT active THEN '' WHEN state = 'missing' THEN 'missing_file' WHEN NOT intact THEN 'hash_mismatch'
  WHEN state = 'stale' THEN 'stale_dependency' ELSE '' END AS issue FROM st""")
def catalog_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = catalog.audit(_states(spark, sf_dir), deep=True)
    return audited.select("video_id", "entry_id", "state", F.coalesce("issue", F.lit("")).alias("issue"))


@query(f"""WITH {_CAT}, a AS (SELECT video_id, CASE WHEN NOT active THEN 'superseded' WHEN state = 'missing' THEN 'missing'
  WHEN NOT intact THEN 'corrupt' ELSE state END AS state FROM st)
SELECT video_id, count(*) FILTER (WHERE state = 'available') AS available, count(*) FILTER (WHERE state = 'stale') AS stale,
  count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'corrupt') AS corrupt,
  count(*) FILTER (WHERE state = 'superseded') AS superseded, count(*) FILTER (WHERE state IN ('missing', 'corrupt')) = 0 AS valid
FROM a GROUP BY video_id""")
def catalog_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.audit_report(catalog.audit(_states(spark, sf_dir), deep=True))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS request_id, CAST(o_custkey AS VARCHAR) AS video_id, 'entry_' || (l_orderkey + l_linenumber) AS dependency
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = l_orderkey + l_linenumber AND p.o_custkey = orders.o_custkey)""")
def catalog_missing_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line asks for the order that many keys ahead, of the same customer."""
    entries, _, _ = order_catalog(spark, sf_dir)
    lines = read_table(spark, sf_dir, "lineitem").join(
        read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    requests = lines.select(
        F.col("l_orderkey").cast("string").alias("request_id"),
        F.col("o_custkey").cast("string").alias("video_id"),
        F.array(F.concat(F.lit("entry_"), F.col("l_orderkey") + F.col("l_linenumber"))).alias("dependency_entry_ids"),
    )
    return catalog.missing_dependencies(requests, entries).select("request_id", "video_id", "dependency")


@query(f"""WITH {_CAT}, head AS (SELECT video_id, max(revision) AS head FROM entries GROUP BY video_id),
c AS (SELECT video_id, key, min_by(entry_id, revision) AS entry_id FROM entries GROUP BY video_id, key)
SELECT c.video_id, head + row_number() OVER (PARTITION BY c.video_id ORDER BY c.key) AS revision, c.key, c.entry_id
FROM c JOIN head USING (video_id) JOIN active a ON a.video_id = c.video_id AND a.key = c.key
WHERE a.entry_id <> c.entry_id""")
def catalog_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-select the oldest entry of every key."""
    entries, selections, _ = order_catalog(spark, sf_dir)
    oldest = entries.groupBy("video_id", "key").agg(F.min_by("entry_id", "revision").alias("entry_id"))
    return catalog.activate(oldest, entries, selections)


@query("""WITH cur AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back FROM orders),
held AS (SELECT * FROM cur WHERE back > 1),
req AS (SELECT cur.*, copy, 2 * o_orderkey + copy AS no, copy = 0 OR back = 3 AS activate FROM cur, (VALUES (0), (1)) c(copy) WHERE back <= 3),
head AS (SELECT o_custkey, max(o_orderkey) AS head FROM held GROUP BY o_custkey),
act AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS k FROM held GROUP BY o_custkey, o_orderpriority),
seen AS (SELECT r.*, head, coalesce(last_value(CASE WHEN activate AND NOT bad THEN o_orderkey END IGNORE NULLS)
    OVER (PARTITION BY r.o_custkey, r.o_orderpriority ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), act.k) AS active
  FROM (SELECT *, copy = 1 AND o_orderkey % 5 = 0 AS bad FROM req) r LEFT JOIN head USING (o_custkey)
  LEFT JOIN act ON act.o_custkey = r.o_custkey AND act.o_orderpriority = r.o_orderpriority),
told AS (SELECT *, CASE WHEN head IS NULL THEN 'video_not_found' WHEN bad THEN 'hash_mismatch' WHEN back = 1 AND copy = 0 THEN 'registered'
  WHEN activate AND active IS DISTINCT FROM o_orderkey THEN 'reactivated' ELSE 'unchanged' END AS outcome FROM seen)
SELECT o_orderkey || '-' || copy AS request_id, outcome,
  coalesce(head + sum(CASE WHEN outcome IN ('registered', 'reactivated') THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY no), -1)::BIGINT AS revision
FROM told""")
def catalog_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register each customer's three latest orders twice into a catalog lacking only the latest.

    Open orders have no derivation key, and some repeated requests name a file of other content.
    """
    entries, selections, _ = order_catalog(spark, sf_dir)
    entries = entries.withColumn("derivation_key", F.when(F.col("derivation_key") != "O", F.col("derivation_key")))
    newest = entries.groupBy("video_id").agg(F.max("revision").alias("newest"))
    held = entries.join(newest, "video_id").where("revision < newest").drop("newest")
    chosen = selections.join(newest, "video_id").where("revision < newest").drop("newest")
    latest = Window.partitionBy("video_id").orderBy(F.desc("revision"))
    asked = entries.withColumn("back", F.row_number().over(latest)).where("back <= 3")
    copies = asked.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(
        {
            "request_id": F.concat_ws("-", "revision", "copy"),
            "request_no": F.col("revision") * 2 + F.col("copy"),
            "activate": (F.col("copy") == 0) | (F.col("back") == 3),
            "uri": F.when((F.col("copy") == 1) & (F.col("revision") % 5 == 0), F.concat("uri", F.lit(".bad"))).otherwise(F.col("uri")),
        }
    )
    files = entries.select(F.concat("uri", F.lit(".bad")).alias("uri"), F.lit("other").alias("sha256"))
    batch = copies.drop("revision", "entry_id", "back", "copy")
    decided = catalog.register(batch, held, chosen, files=files)["decided"]
    return decided.select("request_id", "outcome", F.coalesce("revision", F.lit(-1)).cast("bigint").alias("revision"))


@query(f"""WITH {_CAT}, f AS (
  SELECT video_id, bool_or(key LIKE 'manifest:1%') AS shots, bool_or(key LIKE 'manifest:2%') AS transcript, bool_or(key LIKE 'manifest:3%') AS timeline,
         bool_or(key LIKE 'manifest:4%') AS sparse, bool_or(key LIKE 'manifest:5%') AS dense
  FROM st WHERE active AND state = 'available' GROUP BY video_id),
v AS (SELECT DISTINCT video_id FROM entries),
j AS (SELECT v.video_id, coalesce(shots, false) AS shots_ready, coalesce(transcript, false) AS transcript_ready, coalesce(timeline, false) AS timeline_ready,
  coalesce(sparse, false) AS sparse_search_ready, coalesce(dense, false) AS dense_search_ready FROM v LEFT JOIN f USING (video_id))
SELECT *, CASE WHEN NOT timeline_ready THEN 'failed' WHEN shots_ready AND transcript_ready AND sparse_search_ready AND dense_search_ready THEN 'ready' ELSE 'partial' END AS status,
  concat_ws(' ', CASE WHEN NOT transcript_ready THEN 'No transcript is available; transcript search is disabled.' END,
  CASE WHEN NOT timeline_ready THEN 'No logical chunk timeline is available.' END) AS limitations FROM j""")
def stage_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities stand for the five standard resources."""
    states = _states(spark, sf_dir)
    names = {
        "1": catalog_key_name(F.lit("manifest"), F.lit("primary"), manifest_kind=F.lit("shots")),
        "2": catalog_key_name(F.lit("manifest"), F.lit("primary"), manifest_kind=F.lit("transcript")),
        "3": catalog_key_name(F.lit("manifest"), F.lit("primary"), manifest_kind=F.lit("chunks")),
        "4": catalog_key_name(F.lit("index"), F.lit("primary"), modality=F.lit("transcript"), index_kind=F.lit("bm25")),
        "5": catalog_key_name(F.lit("index"), F.lit("primary"), modality=F.lit("transcript"), index_kind=F.lit("dense")),
    }
    key = F.lit(None).cast("string")
    for digit, name in names.items():
        key = F.when(F.col("key").startswith(f"manifest:{digit}"), name).otherwise(key)
    ready = catalog.readiness(states.withColumn("key", key), states.select("video_id").distinct())
    return catalog.pipeline_status(ready, "optional").withColumn("limitations", F.array_join("limitations", " "))
