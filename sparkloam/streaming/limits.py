"""A bucket of permits that is refilled to its capacity every window."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admitted(events: DataFrame, every: str, capacity: int, *, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The first `capacity` rows of each window, in order of time."""
    w = Window.partitionBy("window_start").orderBy(ts, tie)
    return events.withColumn("window_start", F.window(ts, every)["start"]).withColumn("permit", F.row_number().over(w)).where(F.col("permit") <= capacity)


def admitted_stream(events: DataFrame, every: str, capacity: int, *, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The same over a stream: (window_start, event_id) in order of arrival, with the number
    of permits used as each window's state, dropped when the watermark has passed it."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def take(key, batches: Iterator, state: GroupState) -> Iterator:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        for pdf in batches:
            got = pdf.head(max(0, capacity - used))
            used += len(got)
            yield got[["window_start", "event_id"]]
        state.update((used,))
        # No row of the window can come any more when the watermark has passed its end.
        state.setTimeoutTimestamp(max(int(key[1].timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    w = F.window(ts, every)
    keyed = events.withWatermark(ts, late).withColumn("window_start", w["start"]).withColumn("window_end", w["end"])
    return keyed.groupBy("window_start", "window_end").applyInPandasWithState(take, "window_start timestamp, event_id long", "used long", "append", GroupStateTimeout.EventTimeTimeout)
