"""Gaps in numbered streams, with rows that come out of order."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lists and timers of a key need this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def interval(text: str) -> timedelta:
    """``1 day``, ``90 seconds``"""
    n, unit = text.split()
    return timedelta(**{unit.rstrip("s") + "s": int(n)})


def sequence_gaps(stream: DataFrame, key: str, seq: str, ts: str, late: str = "1 hour", idle: str | None = None) -> DataFrame:
    """(key, expected, found) wherever a key's numbers don't go on by one.

    A number that doesn't follow the last one waits, in the key's list, until the watermark has passed its time. What
    comes until then, in whatever order, closes the gap; what is missing then is one row, and the count goes on from
    the number found. A key's first number is the least of those that wait together. A number that came before
    is a break as well: what follows it is expected, it is found (as in validation of whole tables). Rows later than the watermark are
    dropped, as are those without a number, key or time.

    A key's state is its last number and those that wait. After ``idle`` without rows, in the stream's own time, it is forgotten.
    Timers are the stream's, so a run that starts anew from a checkpoint gives the rows that it would have given.
    Lists and timers need the RocksDB store, which is set for the session.
    """
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import Row

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    idle_ms = int(interval(idle).total_seconds() * 1000) if idle else 0
    kind = dict(stream.dtypes)[key]

    class Gaps(StatefulProcessor):  # local, so that executors needn't have this package
        def init(self, handle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "n long, seen long")
            self.waiting = handle.getListState("waiting", "n long, at long")

        def handleInputRows(self, key, rows, timerValues):
            new = [(r["n"], r["at"]) for r in rows]
            yield from self.settled(key, new, timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs()
            yield from self.settled(key, [], now)
            held = self.last.get()
            if idle_ms and held is not None and held[1] + idle_ms <= now and not self.waiting.exists():
                self.last.clear()

        def settled(self, k, new, now):
            """Take numbers in order as far as nothing can come before them any more."""
            held = self.last.get()
            last, seen = (None, None) if held is None else held
            wait = sorted([*(tuple(w) for w in (self.waiting.get() if self.waiting.exists() else [])), *new])
            seen = max([at for _, at in new] + ([] if seen is None else [seen]), default=None)
            done = 0
            for n, at in wait:
                if last is not None and n <= last:
                    yield Row(k=k[0], expected=n + 1, found=n)
                elif last is not None and n == last + 1:
                    last = n
                elif at <= now:
                    if last is not None:
                        yield Row(k=k[0], expected=last + 1, found=n)
                    last = n
                else:
                    break
                done += 1
            wait = wait[done:]
            if wait:
                self.waiting.put(wait)
                self.handle.registerTimer(wait[0][1])
            elif self.waiting.exists():
                self.waiting.clear()
            if seen is not None:
                self.last.update((last, seen))
                if idle_ms and new and seen + idle_ms > now:
                    self.handle.registerTimer(seen + idle_ms)

        def close(self) -> None:
            pass

    number, at = F.col(seq).try_cast("bigint"), F.unix_millis(F.col(ts).cast("timestamp"))
    rows = stream.withWatermark(ts, late).where(number.isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("k"), number.alias("n"), at.alias("at"), F.col(ts)
    ).where("at is not null")
    found = rows.groupBy("k").transformWithState(Gaps(), f"k {kind}, expected bigint, found bigint", "append", "EventTime")
    return found.withColumnRenamed("k", key)
