"""Audits over live streams of frames.

Each takes a streaming or a batch DataFrame with an event time. Windows and
sessions close by the watermark, so state is bounded by lateness and not by the
length of a stream; the stateful operator keeps ten flags for each stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cadence(frames: DataFrame, keys: list[str], time: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window, keys, frames, first, last) of each window of each stream."""
    rows = frames.withWatermark(time, late) if frames.isStreaming else frames
    return rows.groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("frames"), F.min(time).alias("first"), F.max(time).alias("last"))


def merged_events(events: DataFrame, keys: list[str], time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(session, keys, members): events no further apart than the gap, as sessions that the watermark closes."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count(F.lit(1)).alias("members"))


def sustained_onsets(frames: DataFrame, key: str, order: str, active: str, needed: int = 6, window: int = 10) -> DataFrame:
    """(key, onset): when `needed` of the last `window` frames are active for the first time, the first frame of that window.

    Frames of a stream must arrive in order; a stream is silent after its onset.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flags, orders, done = state.get if state.exists else ([], [], False)
        flags, orders = list(flags), list(orders)
        found = None
        for batch in batches:
            for o, a in batch.sort_values(order)[[order, active]].itertuples(index=False):
                if done:
                    continue
                flags, orders = [*flags, int(a)][-window:], [*orders, int(o)][-window:]
                if len(flags) == window and sum(flags) >= needed:
                    found, done = orders[0], True
        state.update((flags, orders, done))
        if found is not None:
            yield pd.DataFrame({key: [group[0]], "onset": [found]})

    kind = frames.schema[key].dataType.simpleString()
    narrow = frames.select(key, F.col(order).cast("bigint").alias(order), F.col(active).cast("int").alias(active))
    return narrow.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, onset bigint", "flags array<int>, orders array<bigint>, done boolean", "append", GroupStateTimeout.NoTimeout)
