"""The tables a tool works on and the session it runs in."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.operators.clips import ClipPolicy


@dataclass
class Workspace:
    """Manifest tables of any number of videos; ``None`` where a stage did not run."""

    chunks: DataFrame
    shots: DataFrame
    segments: DataFrame | None = None
    text_index: DataFrame | None = None
    dense_index: DataFrame | None = None
    probes: DataFrame | None = None
    readiness: DataFrame | None = None
    dimensions: int = 0

    def of(self, table: str, video_id: str) -> DataFrame:
        frame = getattr(self, table)
        if frame is None:
            raise LookupError(f"{table} is not available")
        return frame.where(frame["video_id"] == video_id)


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class Session:
    """What one conversation has seen.

    Everything here is limited by ``max_tool_calls`` times the hits of a call,
    so it lives on the driver.
    """

    video_id: str
    duration_ms: int | None = None
    max_tool_calls: int = 20
    clip_requested: bool = False
    verified_evidence_ids: frozenset[str] = frozenset()
    clip_policy: ClipPolicy = ClipPolicy()
    calls: int = 0
    no_gain: int = 0
    candidates: dict[str, dict] = field(default_factory=dict)
    evidence: dict[str, dict] = field(default_factory=dict)
    contexts: dict[str, dict] = field(default_factory=dict)
    coverage: list[tuple[int, int]] = field(default_factory=list)
    memory: dict[str, object] = field(default_factory=dict)

    def start_call(self, name: str) -> str:
        if self.calls >= self.max_tool_calls:
            raise BudgetExceeded("tool call budget exhausted")
        self.calls += 1
        return f"{name}_{self.calls:04d}"

    def record_gain(self, gained: bool) -> None:
        self.no_gain = 0 if gained else self.no_gain + 1

    @property
    def requires_replan(self) -> bool:
        return self.no_gain >= 2
