"""Sliding-window admission as a stream: the admitted times of a key live in its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prumo.fixed_values import CLIENT_MAX, CLIENT_WINDOW_SECONDS
from prumo.operators.pacing import SECOND, admit_piece

NEVER_LATE = 7_258_118_400 * SECOND  # the year 2200: the watermark stays behind the clock
DELAY = "spark.watermarkDelayMs"  # by which Spark knows a watermarked column


def admit_stream(
    events: DataFrame,
    key: str,
    at_us: str,
    tie: str,
    most: int = CLIENT_MAX,
    window_seconds: int = CLIENT_WINDOW_SECONDS,
) -> DataFrame:
    """(key, tie, at_us, admitted) for a stream of arrivals.

    Every arrival comes out once, however late it is. Arrivals of one micro-batch are taken in time order; across
    micro-batches the order of arrival counts: a late one is judged by the admitted times still held, later ones
    included. State per key is at most `most` times. It is dropped once the stream's event time has left the key's window
    behind and a window has also passed by the clock since the key was last seen, so neither a backlog nor a client
    whose clock runs ahead takes it from the others; times to come count as now for the stream's event time. An arrival
    later than that is judged as the key's first. The size of a micro-batch, which the source limits, bounds what one
    key can bring to a task.
    """
    window_us = window_seconds * SECOND
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if state.getCurrentProcessingTimeMs() - state.get[1] > window_seconds * 1000:
                state.remove()
            else:
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([at_us, tie])
        flags, held = admit_piece(rows[at_us].to_numpy(), held, most, window_us)
        state.update((held, state.getCurrentProcessingTimeMs()))
        leaves = (max([int(rows[at_us].max()), *held]) + window_us) // 1000 + 1
        state.setTimeoutTimestamp(max(leaves, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], tie: rows[tie].to_numpy(), at_us: rows[at_us].to_numpy(), "admitted": flags})

    return (
        events.select(key, tie, at_us, F.least(F.timestamp_micros(at_us), F.current_timestamp()).alias("_at"))
        .withWatermark("_at", f"{window_seconds} seconds")
        # Spark drops rows whose watermarked column is behind the watermark: the one they go on with never is.
        .select(key, tie, at_us, F.timestamp_micros(F.lit(NEVER_LATE)).alias("_at", metadata={DELAY: window_seconds * 1000}))
        .groupBy(key)
        .applyInPandasWithState(
            step,
            f"{key} {types[key]}, {tie} {types[tie]}, {at_us} bigint, admitted boolean",
            "held array<bigint>, seen_ms bigint",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
