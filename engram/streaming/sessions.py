"""Streams: requests taken once, sessions that close when their user begins another."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CLOSED = "user_id string, session_id string, next_session string, chunk_count long"


def taken_once(requests: DataFrame, time: str = "received_at", delay: str = "10 minutes") -> DataFrame:
    """Of the requests of a key (user_id, request_id) within the watermark, the first. Conflicts of content are found by
    operators.ingest.deduplicated, which sees the whole history."""
    return requests.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["user_id", "request_id"])


def closed_sessions(chunks: DataFrame) -> DataFrame:
    """chunks: user_id, session_id, seq (a stream). A row for each session whose user has gone on to another one. The state of
    a user is its current session and the number of its chunks."""

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, count = state.get if state.exists else (None, 0)
        out = []
        for frame in frames:
            for session in frame.sort_values("seq")["session_id"]:
                if current is not None and session != current:
                    out.append((key[0], current, session, count))
                    count = 0
                current, count = session, count + 1
        state.update((current, count))
        yield pd.DataFrame(out, columns=["user_id", "session_id", "next_session", "chunk_count"])

    return chunks.groupBy("user_id").applyInPandasWithState(each, CLOSED, "current string, n long", "append", GroupStateTimeout.NoTimeout)
