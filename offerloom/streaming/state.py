"""Keyed state with timers: the newest sighting of each listing, forgotten when the listing has not been seen for a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ["source", "external_id"]
LISTED = [*KEYS, "seen_micros", "title"]
#: The state needs a store with column families.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HELD = "source array<string>, external_id array<string>, seen_micros array<long>, title array<string>"
SEEN = "source string, external_id string, seen_micros long, title string, forgotten boolean"
#: Rows that a task gathers before it keeps the newest of each listing.
GATHERED = 200_000
#: Blocks of listings that have a state in common: each costs a few calls of the state a batch, whatever it holds.
BLOCKS = 1024


def newest(rows: pd.DataFrame, *ties: str) -> pd.DataFrame:
    """The newest sighting of each listing; of one time the greatest title, then the greatest of `ties`."""
    return rows.sort_values(["seen_micros", "title", *ties], na_position="first").drop_duplicates(KEYS, keep="last")


def newest_of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The newest sighting of each listing among many rows of a task, so that a listing with many sightings sends few of them to its block."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= GATHERED:
            held = [newest(pd.concat(held))]
            n = len(held[0])
            if 2 * n > GATHERED:
                yield held.pop()
                n = 0
    if held:
        yield newest(pd.concat(held))


class NewestSightings(StatefulProcessor):
    """Of a block of listings a value (when and title of each) and one timer, for the listing that is due first. A late sighting changes nothing;
    a listing that was not seen for `idle` microseconds of event time is given out once more, as forgotten, and leaves the state."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old, come = self._held(), [frame[LISTED].assign(known=False) for frame in rows]
        now = newest(pd.concat([old.assign(known=True), *come] if len(old) else come), "known")
        moved = now[~now["known"]]
        if len(moved):
            self._hold(old, now)
            yield moved[LISTED].assign(forgotten=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self._held()
        gone = self._due(old["seen_micros"]) <= timerValues.getCurrentWatermarkInMs()
        if gone.any():
            self._hold(old, old[~gone])
            yield old[gone].assign(forgotten=True)

    def close(self) -> None:
        pass

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(LISTED, self.state.get() if self.state.exists() else [[]] * len(LISTED), strict=True))).astype({"seen_micros": np.int64})

    def _hold(self, old: pd.DataFrame, now: pd.DataFrame) -> None:
        was, due = (int(self._due(x["seen_micros"].min())) if len(x) else None for x in (old, now))
        if was is not None and was != due:
            self.handle.deleteTimer(was)
        if due is None:
            self.state.clear()
            return
        self.state.update(tuple(now[c].tolist() for c in LISTED))
        if was != due:
            self.handle.registerTimer(due)

    def _due(self, micros):
        """Milliseconds, as timers count: the first watermark that a listing is not within `idle` of. A timer that is set to the watermark of its own batch, or
        before it, never fires; this is always later for what stays."""
        return (micros + self.idle) // 1000 + 1


def remembered_sightings(sightings: DataFrame, delay: str = "1 day", idle_days: float = 30, blocks: int = BLOCKS) -> DataFrame:
    """Changes (source, external_id, last_seen_at, title, forgotten) of the newest sighting of each listing, from a stream of sightings.

    Sightings without a time are left out; a null source or id is a value. State is held for listings that were seen within `idle_days`
    of the watermark, `delay` behind the newest sighting: what comes later than the watermark is dropped, so a forgotten listing never
    comes back with an older time. Of sightings of one time that with the greatest title counts. Rows of a batch are thinned out before they are shuffled.

    Listings are dealt out by hash to `blocks` blocks, whose state is read and written as a whole; a checkpoint goes with its number of blocks.
    """
    sightings.sparkSession.conf.set(*STORE)
    rows = sightings.where(F.col("seen_at").isNotNull()).select(*KEYS, F.unix_micros("seen_at").alias("seen_micros"), "title")
    rows = rows.mapInPandas(newest_of_task, rows.schema).withColumn("seen_at", F.timestamp_micros("seen_micros")).withWatermark("seen_at", delay)
    block = F.pmod(F.xxhash64(*KEYS), F.lit(blocks)).alias("block")
    changes = rows.select(block, *LISTED, "seen_at").groupBy("block").transformWithStateInPandas(NewestSightings(int(idle_days * 86_400_000_000)), SEEN, "Update", "EventTime")
    return changes.select(*KEYS, F.timestamp_micros("seen_micros").alias("last_seen_at"), "title", "forgotten")
