"""The incremental run as a stateful stream: listed items are told apart, due ones refreshed by timers, fetched ones saved.

The stream has a row for each event of an item: `listed`, when a listing shows it, and `fetched`, when its details have
landed. The state of an item is kept under its source and key; it says whether it was seen, and when it is due. A listed
item that is new is to be fetched, a known one refreshed if due and else skipped; an item that falls due without being
listed is refreshed by an event-time timer, once until it is fetched again. Any item is in one partition at a time, and
state and timers survive restarts in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: source, key, event (listed or fetched), at; fetched rows also have status and deadline, the policy's days may be null.
EVENTS = "source string, key string, event string, at timestamp, status string, deadline date, open_days int, other_days int"
ACTIONS = "source string, key string, action string, at timestamp"


def due_at(status: str | None, has_deadline: bool, at: datetime, open_days: int | None, other_days: int | None) -> datetime | None:
    """When an item fetched at a time falls due: open ones with a deadline after open_days, open or unknown ones without after other_days, others never."""
    if status == "open" and has_deadline:
        return at + timedelta(days=open_days or 7)
    if (status or "unknown") in ("open", "unknown") and not has_deadline:
        return at + timedelta(days=other_days or 14)
    return None


def _ms(at: datetime) -> int:
    return int(at.replace(tzinfo=UTC).timestamp() * 1000)


class Items(StatefulProcessor):
    """State of one item: whether it was seen, when it is due (ms, 0 for never), and whether a refresh was asked for since."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "due long, asked boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events = events.sort_values(["at", "event"], kind="stable")  # fetched before listed at one time
        due, asked = self.item.get() if self.item.exists() else (None, False)
        old, out, listed = due, [], set()
        for r in events.itertuples(index=False):
            at = r.at.to_pydatetime()
            if r.event == "fetched":
                days = [None if pd.isna(d) else int(d) for d in (r.open_days, r.other_days)]
                when = due_at(None if pd.isna(r.status) else r.status, not pd.isna(r.deadline), at, *days)
                due, asked = (_ms(when) if when else 0), False
            elif at not in listed:
                listed.add(at)
                if due is None:
                    out.append(("fetch_new", r.at))
                    due = 0
                elif 0 < due <= _ms(at):
                    if not asked:
                        out.append(("refresh", r.at))
                    asked = True
                else:
                    out.append(("skip", r.at))
        self.item.update((due or 0, bool(asked)))
        if old and old != due:
            self.handle.deleteTimer(old)
        if due and due != old:
            self.handle.registerTimer(due)
        yield _actions(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, asked = self.item.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at == due and not asked:
            self.item.update((due, True))
            yield _actions(key, [("refresh", pd.Timestamp(at, unit="ms"))])

    def close(self) -> None:
        pass


def _actions(key, found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"source": [key[0]] * len(found), "key": [key[1]] * len(found), "action": [a for a, _ in found], "at": pd.Series([t for _, t in found], dtype="datetime64[ns]")})


def actions(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """ACTIONS of a stream of EVENTS; rows later than `late` behind the newest one are dropped by the watermark."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = events.filter("source IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).groupBy("source", "key")
    return keyed.transformWithStateInPandas(Items(), ACTIONS, "Append", "EventTime")


def run(spark: SparkSession, folder: str, checkpoint: str, save: Callable[[DataFrame, int], None], late: str = "0 seconds") -> StreamingQuery:
    """The actions of all events that have landed in a folder as JSON rows, each batch given to save with its number; ends when all is done."""
    events = spark.readStream.schema(EVENTS).json(folder)
    return actions(events, late).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
