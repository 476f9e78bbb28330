"""Greedy chunking of segments as they arrive.

``session_window`` would only approximate it: chunks also close on duration,
characters and sentence ends, and a gap must exceed the limit strictly.  The
state per video is the open chunk's scalars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.text import ends_sentence
from tidemark.operators.chunking import ChunkParams, _ChunkRule

OUTPUT_SCHEMA = "video_id STRING, ord BIGINT, segment_id STRING, chunk_no BIGINT"
STATE_SCHEMA = "start_ms BIGINT, end_ms BIGINT, characters BIGINT, closed BOOLEAN, chunk_no BIGINT"


def chunk_labels(segments: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """``chunk_no`` per segment, the same numbers a batch run gives.

    ``segments``: ``video_id, ord, segment_id, start_ms, end_ms,
    normalized_text``; segments of a video must arrive in ``ord`` order across
    micro-batches.
    """
    prepared = segments.select(
        "video_id", "ord", "segment_id", "start_ms", "end_ms",
        F.length("normalized_text").alias("characters"), ends_sentence(F.col("normalized_text")).alias("sentence_end"),
    )

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rule, number, fresh = _ChunkRule(params), -1, True
        if state.exists:
            rule.start, rule.end, rule.characters, rule.closed, number = state.get
            fresh = False
        arrived = pd.concat(list(batches)).sort_values("ord")
        labels = []
        for row in arrived[["start_ms", "end_ms", "characters", "sentence_end"]].itertuples(index=False, name=None):
            number += bool(rule(row, fresh))
            fresh = False
            labels.append(number)
        state.update((int(rule.start), int(rule.end), int(rule.characters), bool(rule.closed), number))
        yield pd.DataFrame(
            {"video_id": key[0], "ord": arrived["ord"], "segment_id": arrived["segment_id"], "chunk_no": labels}
        )

    return prepared.groupBy("video_id").applyInPandasWithState(
        update, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
