"""Per-run session state over a stream of tool calls.

Each call brings candidate ids, an inspected range and the tokens it spent.  The
state of a run is bounded by its call ceiling: known candidates, merged coverage,
the no-gain streak, the spend and the reported budget shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.ledger import BUDGET_THRESHOLDS

OUTPUT_SCHEMA = (
    "run_id STRING, call_no BIGINT, new_candidates BIGINT, reused_candidates BIGINT, newly_covered_ms BIGINT, "
    "covered_ms BIGINT, streak BIGINT, replan BOOLEAN, spent BIGINT, warnings ARRAY<DOUBLE>"
)
STATE_SCHEMA = (
    "seen ARRAY<STRING>, starts ARRAY<BIGINT>, ends ARRAY<BIGINT>, streak BIGINT, spent BIGINT, reported ARRAY<DOUBLE>"
)


def _cover(ranges: list[tuple[int, int]], start: int, end: int) -> tuple[list[tuple[int, int]], int]:
    """Merged ranges with ``[start, end)`` added, and how much of it was new."""
    known = sum(max(0, min(e, end) - max(s, start)) for s, e in ranges)
    merged: list[tuple[int, int]] = []
    for s, e in sorted([*ranges, (start, end)]):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], e))
        else:
            merged.append((s, e))
    return merged, (end - start) - known


def session_ledger(calls: DataFrame, max_total_tokens: int, timeout_ms: int | None = None) -> DataFrame:
    """One row per call.

    ``calls``: ``run_id, call_no, candidate_ids, start_ms, end_ms, tokens``; calls
    of a run must arrive in order across micro-batches.  With ``timeout_ms`` the
    state of silent runs is dropped.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, starts, ends, streak, spent, reported = state.get if state.exists else ([], [], [], 0, 0, [])
        known, ranges, told = set(seen), list(zip(starts, ends)), list(reported)
        rows = []
        for call in pd.concat(list(batches)).sort_values("call_no").itertuples(index=False):
            ids = list(dict.fromkeys([] if call.candidate_ids is None else call.candidate_ids))
            fresh = [i for i in ids if i not in known]
            known.update(fresh)
            gained_ms = 0
            if not pd.isna(call.start_ms):
                ranges, gained_ms = _cover(ranges, int(call.start_ms), int(call.end_ms))
            streak = 0 if fresh or gained_ms else streak + 1
            spent += int(call.tokens)
            crossed = [t for t in BUDGET_THRESHOLDS if spent / max_total_tokens >= t and t not in told]
            told += crossed
            rows.append(
                (key[0], call.call_no, len(fresh), len(ids) - len(fresh), gained_ms,
                 sum(e - s for s, e in ranges), streak, streak >= 2, spent, crossed)
            )
        state.update((sorted(known), [s for s, _ in ranges], [e for _, e in ranges], streak, spent, told))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        names = ["run_id", "call_no", "new_candidates", "reused_candidates", "newly_covered_ms",
                 "covered_ms", "streak", "replan", "spent", "warnings"]
        yield pd.DataFrame(rows, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms is not None else GroupStateTimeout.NoTimeout
    return calls.groupBy("run_id").applyInPandasWithState(update, OUTPUT_SCHEMA, STATE_SCHEMA, "append", timeout)


def first_sightings(hits: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each (run, candidate) once; with a ``watermark`` delay on ``seen_at`` the state is bounded."""
    if watermark is None:
        return hits.dropDuplicates(["run_id", "candidate_id"])
    return hits.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["run_id", "candidate_id"])
