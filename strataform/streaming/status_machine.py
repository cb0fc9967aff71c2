"""Statuses that may follow each other: the same rules over a table, inside the row, and over a stream, with keyed state and timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What may follow what in an import (parameters): a queue, work, and a result that can be tried again.
IMPORT = {"": ("queued",), "queued": ("extracting",), "extracting": ("ready", "failed"), "failed": ("queued",), "ready": ("approved", "queued"), "timed out": ("queued",), "approved": ()}
TIMED_OUT = "timed out"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def transitions(events: DataFrame, key: str, allowed: dict[str, tuple[str, ...]], seconds: int, waiting: tuple[str, ...]) -> DataFrame:
    """(key, event_id, ts, status, before, accepted): for each event (ts, event_id, status) the status that it met, and whether it may follow it.

    A key begins with the status "". Events come in order of time, then of id; one that
    may not follow leaves the status as it is. A status of waiting that nothing followed
    for so many seconds has become "timed out". A key's events are one row while they're
    folded; null statuses follow nothing.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "status"))).alias("events"))
    none = F.struct(F.lit("").alias("status"), F.lit(0).cast("long").alias("since"), F.array().cast("array<struct<before:string,accepted:boolean>>").alias("out"))
    pairs = [f"{a}\x00{b}" for a, after in allowed.items() for b in after]

    def step(acc: Column, x: Column) -> Column:
        at = _micros(x["ts"])
        before = F.when(acc["status"].isin(*waiting) & (at - acc["since"] >= seconds * 1_000_000), TIMED_OUT).otherwise(acc["status"])
        good = F.coalesce(F.concat(before, F.lit("\x00"), x["status"]).isin(*pairs), F.lit(False))
        since = F.when(good, at).when(before == acc["status"], acc["since"]).otherwise(acc["since"] + seconds * 1_000_000)
        return F.struct(F.when(good, x["status"]).otherwise(before).alias("status"), since.alias("since"), F.array_append(acc["out"], F.struct(before.alias("before"), good.alias("accepted"))).alias("out"))

    out = F.aggregate("events", none, step, lambda acc: acc["out"])
    each = rows.select(key, F.inline(F.arrays_zip(F.col("events").alias("e"), out.alias("o"))))
    return each.select(key, "e.event_id", "e.ts", "e.status", "o.before", "o.accepted")


class Machine(StatefulProcessor):
    """The state of one key: its status, since when, and events that the watermark hasn't reached yet."""

    def __init__(self, key: str, allowed: dict[str, tuple[str, ...]], seconds: int, waiting: tuple[str, ...]) -> None:
        self.key, self.allowed, self.seconds, self.waits = key, allowed, seconds, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, since long")
        self.held = handle.getListState("held", "at long, event_id long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            at = round(row["ts"].timestamp() * 1_000_000)  # naive times are local ones, as Spark gives them
            self.held.appendValue((at, row["event_id"], row["status"]))
            self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        status, since = self.now.get() if self.now.exists() else ("", 0)
        rows = sorted((tuple(x) for x in self.held.get()), key=lambda x: (x[0], x[1])) if self.held.exists() else []
        out, later = [], [x for x in rows if x[0] >= upto]
        for at, event, said in [x for x in rows if x[0] < upto] + [(upto, None, None)]:
            if status in self.waits and at - since >= self.seconds * 1_000_000:
                status, since = TIMED_OUT, since + self.seconds * 1_000_000
                out.append((*key, None, since, TIMED_OUT, TIMED_OUT, True))
            if event is not None:
                good = said in self.allowed.get(status, ())
                out.append((*key, event, at, said, status, good))
                status, since = (said, at) if good else (status, since)
        self.now.update((status, since))
        if later:
            self.held.put(later)
        else:
            self.held.clear()
        if status in self.waits:
            self.handle.registerTimer((since + self.seconds * 1_000_000) // 1000 + 1)
        for who, event, at, said, before, good in out:
            yield Row(**{self.key: who, "event_id": event, "ts": datetime.fromtimestamp(at / 1_000_000, timezone.utc), "status": said, "before": before, "accepted": good})

    def close(self) -> None:
        pass


def transitions_of_stream(events: DataFrame, key: str, allowed: dict[str, tuple[str, ...]], seconds: int, waiting: tuple[str, ...], late: str = "1 hour") -> DataFrame:
    """transitions() of a stream (key, ts, event_id, status), however its events are shuffled, as long as none is later than the watermark.

    An event is judged when the watermark has passed it; a status that times out gives a row
    without event_id then. Needs the RocksDB state store.
    """
    kind = events.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, event_id long, ts timestamp, status string, before string, accepted boolean"
    rows = events.select(key, "ts", "event_id", "status").withWatermark("ts", late)
    return rows.groupBy(key).transformWithState(Machine(key, allowed, seconds, waiting), schema, "Append", "EventTime")
