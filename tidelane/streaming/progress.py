"""Search messages folded into each search's progress, in the order of their times, whatever batches they come in.

Each search has a list of messages that are still open to earlier ones, and what the settled ones
add up to. A batch's messages join the list, and the search's progress over all of them, in their
order, goes out; so a `final` that arrives early closes nothing before its time. Once the watermark
has passed a message none before it can come, and a timer moves it from the list to the sum. A
search of which nothing was heard for `keep` of event time is forgotten.

Defined results: messages count in the order of (ts, seq); equal ones in any; expansions add up, a
partial path replaces the one before, a final closes, and nothing counts after it; other kinds are
passed over; messages without a search_id, ts or seq are left out, and so are those that come after
the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RESULT = "search_id long, expansions long, last_partial string, closed boolean"
#: The state store that lists and timers need, as a session's setting.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

Message = tuple[int, int, str, str | None]
Progress = tuple[int, str | None, bool]


def folded(progress: Progress, messages: Iterable[Message]) -> Progress:
    """The progress after further messages, given in their order."""
    n, partial, closed = progress
    for _, _, kind, payload in messages:
        if closed:
            break
        n += kind == "expansion"
        partial = payload if kind == "partial_path" else partial
        closed = kind == "final"
    return n, partial, closed


def _order(message: Message) -> tuple[int, int]:
    return message[0], message[1]


class Searches(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "expansions long, last_partial string, closed boolean, latest long")
        self.open = handle.getListState("open", "at long, seq long, kind string, payload string")

    def _state(self) -> tuple[Progress, int]:
        if not self.settled.exists():
            return (0, None, False), 0
        n, partial, closed, latest = self.settled.get()
        return (int(n), partial, bool(closed)), int(latest)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(s), k, p if isinstance(p, str) else None) for frame in rows for a, s, k, p in zip(frame["at"], frame["seq"], frame["kind"], frame["payload"])]
        progress, latest = self._state()
        before = [tuple(m) for m in self.open.get()] if self.open.exists() else []
        self.open.appendList(new)
        last = max(a for a, *_ in new) // 1000
        if last > latest or not self.settled.exists():
            self.settled.update((*progress, max(last, latest)))
        # When the watermark is past the batch's last message, all of it is settled.
        self.handle.registerTimer(last + 1)
        self.handle.registerTimer(last + self.keep_ms)
        n, partial, closed = folded(progress, sorted([*before, *new], key=_order))
        yield pd.DataFrame({"search_id": [key[0]], "expansions": [n], "last_partial": [partial], "closed": [closed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        progress, latest = self._state()
        messages = sorted((tuple(m) for m in self.open.get()), key=_order) if self.open.exists() else []
        due, rest = [m for m in messages if m[0] < passed * 1000], [m for m in messages if m[0] >= passed * 1000]
        if not rest and passed >= latest + self.keep_ms:
            self.open.clear()
            self.settled.clear()
        elif due:
            self.settled.update((*folded(progress, due), latest))
            self.open.put(rest) if rest else self.open.clear()
        return iter(())


def search_progress(messages: DataFrame, *, late: str = "1 day", keep: str = "7 days") -> DataFrame:
    """search_id, expansions, last_partial, closed of each search that a batch has messages of: a stream in update mode.

    messages: search_id long, ts timestamp, seq long, kind, payload. The query that runs it needs
    the settings in STORE. keep is an interval of event time, in units up to days.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    known = messages.select("search_id", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "kind", "payload").dropna(subset=["search_id", "ts", "seq"])
    rows = known.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("search_id").transformWithStateInPandas(Searches(keep_ms), RESULT, "Update", "EventTime")
