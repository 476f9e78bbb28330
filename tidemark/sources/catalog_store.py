"""The artifact catalog as two tables under one commit log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import catalog
from tidemark.session import cut_lineage
from tidemark.sources.commit_log import CommitConflict, CommitLog


class RevisionConflict(RuntimeError):
    """A video moved on since the caller read it."""


class CatalogStore:
    """Reads and commits; all decisions are made by :mod:`tidemark.operators.catalog`.

    Entries and selections of one call appear together.  Any number of writers may work at
    once: a call that lost the race for a commit number decides anew on what the winner left,
    and fails with :class:`RevisionConflict` where its ``expected_revisions`` are outdated then.
    """

    def __init__(self, spark: SparkSession, root: str, attempts: int = 10) -> None:
        self.spark, self.attempts = spark, attempts
        self.log = CommitLog(spark, root, {"entries": catalog.ENTRY_SCHEMA, "selections": catalog.SELECTION_SCHEMA})

    def initialise(self) -> "CatalogStore":
        if self.log.head() < 0:
            try:
                self.log.commit({}, -1)
            except CommitConflict:
                pass  # another writer has just done it
        return self

    @property
    def entries(self) -> DataFrame:
        return self.log.read("entries")

    @property
    def selections(self) -> DataFrame:
        return self.log.read("selections")

    def create_videos(self, assets: DataFrame) -> DataFrame:
        def decide(entries: DataFrame, selections: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
            decided = cut_lineage(catalog.create_videos(assets, selections, entries))
            fresh = decided.where("outcome = 'created'").drop("outcome")
            rows = {"entries": fresh, "selections": fresh.select("video_id", "revision", "key", "entry_id")}
            return decided.select("video_id", "entry_id", "outcome"), rows

        return self._committed(decide)

    def register(self, batch: DataFrame, expected_revisions: DataFrame | None = None) -> DataFrame:
        def decide(entries: DataFrame, selections: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
            planned = catalog.register(batch, entries, selections, expected_revisions)
            decided = cut_lineage(planned["decided"])
            if decided.where("outcome = 'revision_conflict'").limit(1).count():
                raise RevisionConflict("expected revision does not match the catalog")
            return decided, {"entries": planned["entries"], "selections": planned["selections"]}

        return self._committed(decide)

    def activate(self, choices: DataFrame) -> None:
        self._committed(lambda entries, selections: (choices, {"selections": cut_lineage(catalog.activate(choices, entries, selections))}))

    def states(self, files: DataFrame | None = None, allowed_roots: tuple[str, ...] = ()) -> DataFrame:
        return catalog.entry_states(self.entries, self.selections, files, allowed_roots)

    def compact(self) -> None:
        """Gather what many commits have left in one folder for each table."""
        self.log.compact()

    def _committed(self, decide: Callable[[DataFrame, DataFrame], tuple[DataFrame, dict[str, DataFrame]]]) -> DataFrame:
        for _ in range(self.attempts):
            head = self.log.head()
            decided, rows = decide(self.log.read("entries", head), self.log.read("selections", head))
            rows = {name: cut_lineage(df) for name, df in rows.items()}
            if all(df.isEmpty() for df in rows.values()):
                return decided
            try:
                self.log.commit(rows, head)
                return decided
            except CommitConflict:
                continue
        raise CommitConflict(f"lost {self.attempts} races for the next commit")
