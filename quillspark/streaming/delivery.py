"""Delivery with retries, dead letters, deduplication and silence as one stateful processor, by ``transformWithState``.

Per key: a value (the attempt under way), a list (the ids of outcomes that were already counted, so that a redelivered outcome counts
once), a value with a time to live (a settled key stays settled for that long), and timers: one for the next attempt, one for
silence.  State and timers are in the query's checkpoint (RocksDB), so a restart in the middle of a wait delivers when the wait is over.

Processing time drives retries: the clock is what a back-off means.  Event time drives :class:`Silence`: a worker is stale
when the stream's own time has passed its last beat.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIONS = "key string, attempt int, action string, delay_s double"
#: An outcome that means nothing: it only makes the stream go on.
TICK = "tick"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Delivery(StatefulProcessor):
    """(key, id, outcome) to (key, attempt, action, delay_s).

    A transient outcome backs off, from ``base_s`` doubling up to ``most_s``, and a timer then says ``redeliver``; a permanent one and
    the last of ``attempts`` go to the dead letters.  An id that was counted, and any outcome of a settled key within ``settled_s``, changes nothing.
    """

    def __init__(self, base_s: float = 15.0, most_s: float = 1800.0, attempts: int = 8, settled_s: float = 30 * 86_400.0):
        self.base_s, self.most_s, self.attempts, self.settled_s = base_s, most_s, attempts, settled_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempt = handle.getValueState("attempt", "n int")
        self.counted = handle.getListState("counted", "id string")
        self.settled = handle.getValueState("settled", "action string", ttlDurationMs=int(self.settled_s * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempt = self.attempt.get()[0] if self.attempt.exists() else 0
        counted = {x[0] for x in self.counted.get()} if self.counted.exists() else set()
        out = []
        for frame in rows:
            for i, outcome in zip(frame["id"], frame["outcome"]):
                if outcome == TICK or i in counted or self.settled.exists():
                    continue
                counted.add(i)
                self.counted.appendValue((i,))
                attempt += 1
                if outcome == "ok" or outcome == "permanent" or attempt >= self.attempts:
                    action, delay = ("done" if outcome == "ok" else "dead"), 0.0
                    self.settled.update((action,))
                else:
                    action, delay = "retry", min(self.most_s, self.base_s * 2 ** (attempt - 1))
                out.append((key[0], attempt, action, delay))
        if not out:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if out[-1][2] == "retry":
            self.attempt.update((attempt,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, int(1000 * out[-1][3])))
        else:
            self.attempt.clear()
            self.counted.clear()
        yield pd.DataFrame(out, columns=["key", "attempt", "action", "delay_s"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ARG002
        attempt = self.attempt.get()[0] if self.attempt.exists() else 0
        yield pd.DataFrame([(key[0], attempt + 1, "redeliver", 0.0)], columns=["key", "attempt", "action", "delay_s"])

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """(worker, at) to (worker, last): workers whose last beat is over ``stale_s`` older than the stream's time, once each silence."""

    def __init__(self, stale_s: float = 120.0):
        self.stale_s = stale_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ARG002
        seen = [int(f["at"].max().timestamp() * 1000) for f in rows]
        last = max(seen + ([self.last.get()[0]] if self.last.exists() else []))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last,))
        self.handle.registerTimer(last + int(self.stale_s * 1000))
        yield pd.DataFrame({"worker": pd.Series(dtype=str), "last_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ARG002
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"worker": [key[0]], "last_ms": [last]})

    def close(self) -> None:
        pass


def ticks(spark: SparkSession, every_s: int = 1) -> DataFrame:
    """A stream of ticks: after a restart Spark runs timers only with a batch, and a batch only when rows have come."""
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", every_s * 1000).load()
    return rate.select(F.lit("").alias("key"), F.lit(None).cast("string").alias("id"), F.lit(TICK).alias("outcome"))


def deliver(outcomes: DataFrame, processor: Delivery | None = None, tick: bool = True) -> DataFrame:
    """A stream of outcomes (key, id, outcome) to actions; needs RocksDB as the session's state store (:data:`PROVIDER`)."""
    rows = outcomes.select("key", "id", "outcome")
    rows = rows.unionByName(ticks(outcomes.sparkSession)) if tick else rows
    return rows.groupBy("key").transformWithStateInPandas(processor or Delivery(), ACTIONS, "append", "processingTime")


def silent(beats: DataFrame, stale_s: float = 120.0, delay: str = "0 seconds") -> DataFrame:
    """A stream of beats (worker, at) to the workers that fell silent."""
    return beats.withWatermark("at", delay).groupBy("worker").transformWithStateInPandas(Silence(stale_s), "worker string, last_ms long", "append", "eventTime")
