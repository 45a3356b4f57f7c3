"""Running size, engagement and peak hour of every conversation in keyed state.

Each conversation has a value state with its totals and its peak so far, a map state with
its posts per clock hour, and one event-time timer. A micro-batch adds its rows and emits
the conversation's new totals: files may come in any order, since totals are sums and an
hour's count only grows, which lets the peak be kept without reading the other hours. When
the watermark passes the last post by ``idle``, the timer emits the totals once more,
marked closed, and the state is dropped; later posts would begin a new record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_HOUR_MS = 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ConversationTotals(StatefulProcessor):
    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, engagement double, peak_ms long, peak_n long, last_ms long")
        self.hours = handle.getMapState("hours", "hour_ms long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[int, int] = {}
        n, engagement, peak_ms, peak_n, last = self.totals.get() if self.totals.exists() else (0, 0.0, None, 0, None)
        before = last
        for frame in rows:
            n += len(frame)
            engagement += float(frame["engagement"].sum())
            for hour, c in frame["hour_ms"].value_counts().items():
                counts[int(hour)] = counts.get(int(hour), 0) + int(c)
            newest = int(frame["time_ms"].max())
            last = newest if last is None else max(last, newest)
        for hour, c in counts.items():
            old = self.hours.getValue((hour,)) if self.hours.containsKey((hour,)) else None
            c += old[0] if old else 0
            self.hours.updateValue((hour,), (c,))
            if c > peak_n or (c == peak_n and hour < peak_ms):
                peak_ms, peak_n = hour, c
        self.totals.update((n, engagement, peak_ms, peak_n, last))
        if before != last:
            if before is not None:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key, n, engagement, peak_ms, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, engagement, peak_ms, _, _ = self.totals.get()
        self.totals.clear()
        self.hours.clear()
        yield self._row(key, n, engagement, peak_ms, True)

    def close(self) -> None:
        pass

    def _row(self, key, n, engagement, peak_ms, closed) -> pd.DataFrame:
        return pd.DataFrame({"conversation": [key[0]], "n_posts": [n], "engagement": [engagement], "peak_ms": [peak_ms], "closed": [closed]})


def conversation_totals(posts: DataFrame, time: str, conversation: str, engagement: str,
                        lateness: str = "30 days", idle_hours: int = 24 * 7) -> DataFrame:
    """A stream of ``(conversation, n_posts, engagement, peak_hour, closed)``: new totals of every conversation a batch touches.

    The peak is the clock hour with most posts, the earliest of equals. Rows without a
    conversation or a time take no part; a missing engagement counts as 0. Rows later than
    ``lateness`` behind the newest are dropped. The stream keeps state in RocksDB: set
    ``spark.sql.streaming.stateStore.providerClass`` to ``PROVIDER``.
    """
    ms = F.unix_millis(time)
    rows = (
        posts.where(F.col(conversation).isNotNull() & F.col(time).isNotNull()).withWatermark(time, lateness)
        .select(F.col(conversation).alias("conversation"), time, ms.alias("time_ms"), (ms - F.pmod(ms, F.lit(_HOUR_MS))).alias("hour_ms"),
                F.coalesce(F.col(engagement).cast("double"), F.lit(0.0)).alias("engagement"))
    )
    kind = posts.schema[conversation].dataType.simpleString()
    totals = rows.groupBy("conversation").transformWithStateInPandas(
        ConversationTotals(idle_hours * _HOUR_MS), f"conversation {kind}, n_posts long, engagement double, peak_ms long, closed boolean",
        "Update", "EventTime")
    return totals.select("conversation", "n_posts", "engagement", F.timestamp_millis("peak_ms").alias("peak_hour"), "closed")
