"""Versioned artifact catalog: selections, staleness, reuse, audit, registration.

Two append-only tables cover any number of videos:

* ``entries``: ``video_id, revision, entry_id, key, content_sha256, uri,
  size_bytes, dependency_entry_ids, derivation_key, producer_name,
  producer_version``
* ``selections``: ``video_id, revision, key, entry_id`` - the latest revision of
  a key is its active entry.

``files`` (``uri, sha256``), where given, is what the storage really holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY_SCHEMA = (
    "video_id string, revision bigint, entry_id string, key string, content_sha256 string, "
    "uri string, size_bytes bigint, dependency_entry_ids array<string>, derivation_key string, "
    "producer_name string, producer_version string"
)
SELECTION_SCHEMA = "video_id string, revision bigint, key string, entry_id string"


def active_selections(selections: DataFrame) -> DataFrame:
    """Latest selection per (video, key); an aggregate, so it combines map-side."""
    return selections.groupBy("video_id", "key").agg(
        F.max_by("entry_id", "revision").alias("entry_id"), F.max("revision").alias("revision")
    )


def list_entries(entries: DataFrame, key: str | None = None) -> DataFrame:
    return entries if key is None else entries.where(F.col("key") == key)


def missing_dependencies(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """``video_id, request_id, dependency`` rows no entry of the video backs."""
    wanted = requests.select(
        "video_id", "request_id", F.explode("dependency_entry_ids").alias("dependency")
    )
    known = entries.select("video_id", F.col("entry_id").alias("dependency"))
    return wanted.join(known, ["video_id", "dependency"], "left_anti").select(
        "video_id", "request_id", "dependency"
    )


def stale_dependencies(entries: DataFrame, selections: DataFrame) -> DataFrame:
    """``video_id, entry_id, dependency``: direct dependencies that are not active."""
    wanted = entries.select(
        "video_id", "entry_id", F.explode("dependency_entry_ids").alias("dependency")
    )
    active = active_selections(selections).select("video_id", F.col("entry_id").alias("dependency"))
    return wanted.join(active, ["video_id", "dependency"], "left_anti").select(
        "video_id", "entry_id", "dependency"
    )


def entry_states(
    entries: DataFrame,
    selections: DataFrame,
    files: DataFrame | None = None,
    allowed_roots: Sequence[str] = (),
) -> DataFrame:
    """Every entry with ``state``: corrupt path, then missing, stale, available.

    Staleness looks one level deep; ``intact`` says whether the stored file has the entry's hash.
    """
    stale = (
        stale_dependencies(entries, selections)
        .groupBy("video_id", "entry_id")
        .agg(F.count(F.lit(1)).alias("n_stale"))
    )
    # the columns that staleness joins too, so that both read one shuffle
    active = active_selections(selections).select(F.col("video_id").alias("_video"), F.col("entry_id").alias("_selected"))
    allowed = F.lit(True)
    if allowed_roots:
        allowed = F.lit(False)
        for root in allowed_roots:
            allowed = allowed | F.col("uri").startswith(root.rstrip("/") + "/")
        allowed = allowed & ~F.col("uri").contains("/../")
    if files is not None:
        held = files.select("uri", F.col("sha256").alias("file_sha256"), _packed("sha256").alias("_held"))
        checked = entries.withColumn("_content", _packed("content_sha256")).join(held, "uri", "left")
        present = F.col("_held").isNotNull()
    else:
        same = _packed("content_sha256")
        checked = entries.withColumns({"file_sha256": F.col("content_sha256"), "_held": same, "_content": same})
        present = F.lit(True)
    # decided before the other joins, which then need not carry paths and hashes
    checked = checked.withColumns(
        {"intact": F.col("_held") == F.col("_content"), "_allowed": allowed, "_present": present}
    ).drop("_held", "_content")
    joined = checked.join(stale, ["video_id", "entry_id"], "left")
    selected = (F.col("video_id") == F.col("_video")) & (F.col("entry_id") == F.col("_selected"))
    joined = joined.join(active, selected, "left").withColumn("active", F.col("_selected").isNotNull()).drop("_video", "_selected")
    state = (
        F.when(~F.col("_allowed"), "corrupt")
        .when(~F.col("_present"), "missing")
        .when(F.col("n_stale") > 0, "stale")
        .otherwise("available")
    )
    return joined.withColumns(
        {"state": state, "n_stale": F.coalesce("n_stale", F.lit(0))}
    ).drop("_allowed", "_present")


def _packed(digest: str) -> Column:
    """A digest in half the bytes where it is lower-case hex, else as it is; equal only where digests are."""
    raw = F.unhex(digest)
    return F.when(F.lower(F.hex(raw)) == F.col(digest), F.concat(F.lit(b"\0"), raw)).otherwise(F.concat(F.lit(b"\1"), F.encode(digest, "utf-8")))


def resolve(states: DataFrame, require_fresh: bool = True) -> DataFrame:
    """Active entries with the error a lookup would raise (NULL when usable)."""
    code = (
        F.when(F.col("state") == "stale", "stale_resource")
        .when(F.col("state") == "missing", "resource_missing")
        .when(F.col("state") == "corrupt", "corrupt_resource")
    )
    return states.where("active").withColumn(
        "error_code", code if require_fresh else F.lit(None).cast("string")
    )


def find_reusable(states: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest available, hash-intact entry per request.

    ``requests``: ``request_id, video_id, key, derivation_key,
    dependency_entry_ids``; requests without a match are absent.
    """
    usable = states.where((F.col("state") == "available") & F.col("intact"))
    on = ["video_id", "key", "derivation_key", "dependency_entry_ids"]
    # one value for each group instead of a revision, an entry and what they are ordered by
    newest = usable.groupBy(*on).agg(F.max(F.struct("revision", "entry_id")).alias("last")).select(*on, "last.entry_id", "last.revision")
    # a derivation key may be unknown on both sides, which is then the same key
    return requests.join(newest, _same(requests, newest, on)).select(
        requests["request_id"], requests["video_id"], requests["key"], newest["entry_id"], newest["revision"]
    )


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equality on all of ``names``, where nulls equal each other."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def audit(states: DataFrame, deep: bool = False) -> DataFrame:
    """``video_id, entry_id, state, issue``: superseded entries are not examined further."""
    broken = F.lit(deep) & (F.col("state") != "missing") & (F.col("state") != "corrupt") & ~F.col("intact")
    state = F.when(~F.col("active"), "superseded").when(broken, "corrupt").otherwise(F.col("state"))
    issue = (
        F.when(~F.col("active"), None)
        .when(F.col("state") == "missing", "missing_file")
        .when(F.col("state") == "corrupt", "path_not_allowed")
        .when(broken, "hash_mismatch")
        .when(F.col("state") == "stale", "stale_dependency")
    )
    return states.select("video_id", "entry_id", "key", state.alias("state"), issue.alias("issue"))


def audit_report(audited: DataFrame) -> DataFrame:
    """State counts per video; ``valid`` is false with any missing or corrupt active entry."""
    def count(name: str):
        return F.count_if(F.col("state") == name).alias(name)

    return (
        audited.groupBy("video_id")
        .agg(*[count(s) for s in ("available", "stale", "missing", "corrupt", "superseded")])
        .withColumn("valid", (F.col("missing") == 0) & (F.col("corrupt") == 0))
    )


def create_videos(assets: DataFrame, selections: DataFrame, entries: DataFrame) -> DataFrame:
    """Source entries for videos the catalog does not hold yet.

    ``assets``: ``video_id, uri, sha256, size_bytes``.  The result has an
    ``outcome`` of ``created``, ``unchanged`` or ``video_already_registered``.
    """
    source_key = F.lit("source:source_video:primary")
    known = entries.where(F.col("key") == source_key).groupBy("video_id").agg(
        F.min_by("uri", "revision").alias("known_uri"),
        F.min_by("content_sha256", "revision").alias("known_sha256"),
    )
    same = (F.col("uri") == F.col("known_uri")) & (F.col("sha256") == F.col("known_sha256"))
    outcome = (
        F.when(F.col("known_uri").isNull(), "created").when(same, "unchanged").otherwise("video_already_registered")
    )
    return assets.join(known, "video_id", "left").select(
        "video_id",
        F.lit(1).cast("bigint").alias("revision"),
        F.concat(F.lit("entry_"), F.substring(F.sha2(F.concat_ws("|", "video_id", "sha256"), 256), 1, 24)).alias("entry_id"),
        source_key.alias("key"),
        F.col("sha256").alias("content_sha256"),
        "uri",
        "size_bytes",
        F.array().cast("array<string>").alias("dependency_entry_ids"),
        F.col("sha256").alias("derivation_key"),
        F.lit("video-registration").alias("producer_name"),
        F.lit("1").alias("producer_version"),
        outcome.alias("outcome"),
    )


IDENTITY = (
    "video_id", "key", "content_sha256", "dependency_entry_ids", "derivation_key", "producer_name", "producer_version",
)


def register(
    batch: DataFrame,
    entries: DataFrame,
    selections: DataFrame,
    expected_revisions: DataFrame | None = None,
    files: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Plan the registrations of a whole batch, any number per video.

    ``batch``: an entry without ``revision``/``entry_id`` plus ``request_id`` and
    ``activate``, and ``request_no`` where the requests of a video have another order
    than that of ``request_id``.  They take effect one after the other: each that
    changes the catalog raises its video's revision by one, and a later request sees
    what an earlier one stored or selected.  Returns ``decided`` (one ``outcome`` per
    request), and the ``entries`` and ``selections`` rows to append.  An identical
    entry is not stored again; it is only re-selected when asked to and not active.

    ``files`` (``uri, sha256``): what the storage holds; a request whose declared
    hash differs from it is refused.
    """
    head = (
        entries.select("video_id", "revision")
        .unionByName(selections.select("video_id", "revision"))
        .groupBy("video_id")
        .agg(F.max("revision").alias("head"))
    )
    twins = entries.groupBy(*IDENTITY).agg(F.min_by("entry_id", "revision").alias("twin"))
    active = active_selections(selections).select("video_id", "key", F.col("entry_id").alias("active_entry"))
    missing = (
        missing_dependencies(batch, entries).groupBy("video_id", "request_id").agg(F.count(F.lit(1)).alias("n_missing"))
    )
    numbered = batch if "request_no" in batch.columns else batch.withColumn("request_no", F.col("request_id"))
    joined = (
        numbered.join(twins, _same(numbered, twins, IDENTITY), "left")
        .select(*[numbered[c] for c in numbered.columns], twins["twin"])
        .join(active, ["video_id", "key"], "left")
        .join(missing, ["video_id", "request_id"], "left")
    )
    conflict, mismatch = F.lit(False), F.lit(False)
    if files is not None:
        joined = joined.join(files.select("uri", F.lower("sha256").alias("file_sha256")), "uri", "left")
        mismatch = F.coalesce(F.col("file_sha256") != F.lower("content_sha256"), F.lit(False))
    # videos are joined last: what follows is decided inside a video and needs no other shuffle
    joined = joined.join(head, "video_id", "left")
    if expected_revisions is not None:
        joined = joined.join(expected_revisions.select("video_id", "expected_revision"), "video_id", "left")
        conflict = F.coalesce(F.col("expected_revision") != F.col("head"), F.lit(False))
    refused = (
        F.when(F.col("head").isNull(), "video_not_found")
        .when(conflict, "revision_conflict")
        .when(F.col("n_missing") > 0, "dependency_not_found")
        .when(mismatch, "hash_mismatch")
    )
    fresh_id = F.concat(
        F.lit("entry_"), F.substring(F.sha2(F.concat_ws("|", "video_id", "request_id", "content_sha256"), 256), 1, 24)
    )
    joined = joined.withColumn("refused", refused).withColumn("valid", F.col("refused").isNull())
    # the first valid request for content that is not stored yet stores it
    alike = Window.partitionBy(*IDENTITY, "valid").orderBy("request_no", "request_id")
    joined = joined.withColumn("stored_by", F.first("request_id").over(alike)).withColumn("stored_id", F.first(fresh_id).over(alike))
    joined = joined.withColumns(
        {
            "stores": F.col("valid") & F.col("twin").isNull() & (F.col("stored_by") == F.col("request_id")),
            "entry_id": F.when(F.col("valid"), F.coalesce("twin", "stored_id")),
        }
    )
    # after a request that selects, its entry is the active one, whatever was before
    earlier = Window.partitionBy("video_id", "key").orderBy("request_no", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    chosen = F.when(F.col("valid") & F.col("activate"), F.col("entry_id"))
    joined = joined.withColumn("active_entry", F.coalesce(F.last(chosen, ignorenulls=True).over(earlier), F.col("active_entry")))
    outcome = (
        F.when(~F.col("valid"), F.col("refused"))
        .when(F.col("stores"), "registered")
        .when(F.col("activate") & ~F.col("entry_id").eqNullSafe(F.col("active_entry")), "reactivated")
        .otherwise("unchanged")
    )
    joined = joined.withColumn("outcome", outcome).withColumn("changes", F.col("outcome").isin("registered", "reactivated"))
    sofar = Window.partitionBy("video_id").orderBy("request_no", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    decided = joined.withColumn("revision", F.col("head") + F.sum(F.col("changes").cast("bigint")).over(sofar))
    stored = decided.where(F.col("outcome") == "registered")
    selected = decided.where(
        (F.col("outcome") == "reactivated") | ((F.col("outcome") == "registered") & F.col("activate"))
    )
    return {
        "decided": decided.select("request_id", "video_id", "key", "entry_id", "revision", "outcome"),
        "entries": stored.select(*[c for c in entries.columns]),
        "selections": selected.select("video_id", "revision", "key", "entry_id"),
    }


def activate(choices: DataFrame, entries: DataFrame, selections: DataFrame) -> DataFrame:
    """Selection rows for ``choices`` (``video_id, key, entry_id``) that are not active yet.

    Choices naming an unknown entry or one of another key are left out.  They take
    effect one after the other, in the order of ``choice_no`` where given, else of key
    and entry: each change raises its video's revision by one.
    """
    head = selections.groupBy("video_id").agg(F.max("revision").alias("s")).join(
        entries.groupBy("video_id").agg(F.max("revision").alias("e")), "video_id", "full_outer"
    ).select("video_id", F.greatest("s", "e").alias("head"))
    valid = choices.join(entries.select("video_id", "key", "entry_id"), ["video_id", "key", "entry_id"], "left_semi")
    order = [*(["choice_no"] if "choice_no" in choices.columns else []), "key", "entry_id"]
    active = active_selections(selections).select("video_id", "key", F.col("entry_id").alias("active_entry"))
    before = F.coalesce(F.lag("entry_id").over(Window.partitionBy("video_id", "key").orderBy(*order)), F.col("active_entry"))
    changed = valid.join(active, ["video_id", "key"], "left").withColumn("before", before)
    changed = changed.where(~F.col("entry_id").eqNullSafe(F.col("before"))).join(head, "video_id")
    number = F.row_number().over(Window.partitionBy("video_id").orderBy(*order))
    return changed.select("video_id", (F.col("head") + number).cast("bigint").alias("revision"), "key", "entry_id")


def check_loads(requests: DataFrame, entries: DataFrame, selections: DataFrame, files: DataFrame, contents: DataFrame) -> DataFrame:
    """``requests`` with the ``entry_id`` that would be loaded and an ``outcome``.

    ``requests``: ``video_id, key, expected_kind``; ``files`` (``uri, sha256``): what the storage
    holds; ``contents`` (``uri, content_video_id, content_kind``): what the files say of
    themselves.  The kind of an entry is the second part of its key.  In this order:
    ``not_found`` (nothing active under the key), ``type_mismatch`` (another kind is asked for),
    ``missing`` (no such file), ``hash_mismatch`` (the file has changed), ``corrupt`` (the file
    says nothing or another kind), ``identity_mismatch`` (another video's), ``loaded``.
    """
    active = active_selections(selections).drop("revision")
    known = active.join(entries.select("video_id", "entry_id", "uri", "content_sha256"), ["video_id", "entry_id"])
    held = files.groupBy("uri").agg(F.max(F.lower("sha256")).alias("_held"))
    said = contents.groupBy("uri").agg(F.max(F.struct("content_video_id", "content_kind")).alias("_said"))
    joined = requests.join(known, ["video_id", "key"], "left").join(held, "uri", "left").join(said, "uri", "left")
    outcome = (
        F.when(F.col("entry_id").isNull(), "not_found")
        .when(~F.element_at(F.split("key", ":"), 2).eqNullSafe(F.col("expected_kind")), "type_mismatch")
        .when(F.col("_held").isNull(), "missing")
        .when(F.col("_held") != F.lower("content_sha256"), "hash_mismatch")
        .when(F.col("_said").isNull() | ~F.col("_said.content_kind").eqNullSafe(F.col("expected_kind")), "corrupt")
        .when(~F.col("_said.content_video_id").eqNullSafe(F.col("video_id")), "identity_mismatch")
        .otherwise("loaded")
    )
    return joined.select(*requests.columns, "entry_id", outcome.alias("outcome"))


def readiness(states: DataFrame, videos: DataFrame) -> DataFrame:
    """Which stages of a video are usable, and what is limited."""
    # The catalog keys of the standard stages.
    stage_keys = {
        "shots_ready": "manifest:shots:primary",
        "transcript_ready": "manifest:transcript:primary",
        "timeline_ready": "manifest:chunks:primary",
        "sparse_search_ready": "index:transcript:bm25:primary",
        "dense_search_ready": "index:transcript:dense:primary",
    }
    usable = resolve(states).where(F.col("error_code").isNull())
    flags = usable.groupBy("video_id").agg(
        *[F.bool_or(F.col("key") == key).alias(name) for name, key in stage_keys.items()]
    )
    joined = videos.select("video_id").join(flags, "video_id", "left")
    return joined.select(
        "video_id", *[F.coalesce(F.col(name), F.lit(False)).alias(name) for name in stage_keys]
    ).withColumn(
        "limitations",
        F.array_compact(
            F.array(
                F.when(~F.col("transcript_ready"), "No transcript is available; transcript search is disabled."),
                F.when(~F.col("timeline_ready"), "No logical chunk timeline is available."),
            )
        ),
    )


def pipeline_status(ready: DataFrame, dense_policy: str = "disabled") -> DataFrame:
    """READY / PARTIAL / FAILED from stage readiness and the dense-index policy."""
    if dense_policy not in ("disabled", "optional", "required"):
        raise ValueError(f"unknown dense policy: {dense_policy}")
    dense_expected = dense_policy != "disabled"
    complete = F.col("shots_ready") & F.col("transcript_ready") & F.col("sparse_search_ready")
    if dense_expected:
        complete = complete & F.col("dense_search_ready")
    failed = ~F.col("timeline_ready")
    if dense_policy == "required":
        failed = failed | ~F.col("dense_search_ready")
    return ready.withColumn(
        "status", F.when(failed, "failed").when(complete, "ready").otherwise("partial")
    )
