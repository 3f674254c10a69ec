"""Structured Streaming: the checkpointed delta pass with its restart, signals, retries with dead letters, and heartbeats."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indexing
from ..sources.feed import TokenExpired
from ..storage.log import LogTable


def written_once(df: DataFrame, folder: str, epoch: int, run: str = "run", buckets: int = 1) -> None:
    """Append a batch's rows to a log table under its run and epoch: the same batch again adds nothing."""
    LogTable(df.sparkSession, folder, ", ".join(f"`{c}` {t}" for c, t in df.dtypes), buckets).append(df, (run, epoch))


def delta_pass(feed: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], trigger_s: float | None = None):
    """One idempotent handler per batch; the offset moves only after it returns.  Without a period: all there is, once."""
    writer = feed.writeStream.foreachBatch(lambda df, epoch: handle(df, epoch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{trigger_s} seconds") if trigger_s else writer.trigger(availableNow=True)).start()


def with_restart(start: Callable[[str, int], object], checkpoint: str, reset: Callable[[int], None], most: int = 3) -> int:
    """Run ``start(checkpoint folder, page)`` to its end; where the feed's token has expired, call ``reset`` and begin a full walk.

    Each walk has a checkpoint folder of its own, so the old offsets are void.  Returns the number of walks.
    """
    after = -1
    for walk in range(most):
        query = start(f"{checkpoint}/walk={walk}", after)
        try:
            query.awaitTermination()
            return walk + 1
        except Exception as e:  # noqa: BLE001  whatever else failed goes on to the caller
            found = re.search(r"TokenExpired\((\d+)\)", str(e))
            if not found:
                raise
            after = int(found[1])
            reset(after)
    raise RuntimeError(f"the feed expired {most} times in a row")


def index_batch(table: LogTable, allowed: list[str], fingerprint: str, walk: str = "walk=0") -> Callable[[DataFrame, int], None]:
    """A handler that keeps the file table: removed rows go, changed ones are replaced, and only their buckets are rewritten.

    A batch is one version of the table under its walk and epoch, so replaying it changes nothing, whether it died before the version
    or after it.  Tables with a ``scan_id`` say which walk saw a row last; :func:`end_walk` drops the rest.
    """

    def handle(changes: DataFrame, epoch: int) -> None:
        spark = changes.sparkSession
        if "expired" in changes.columns:
            page = changes.filter("expired").agg(F.max("page")).first()[0]
            if page is not None:
                raise TokenExpired(page)
        if table.state().has((walk, epoch)):
            return
        gone = F.col("is_deleted") | (F.col("is_file") & ~indexing.extension_allowed(F.col("name"), allowed))
        # A folder takes no part, neither as a row nor as a removal.
        rows = changes.filter(F.col("is_deleted") | F.col("is_file")).withColumn("arrival", F.struct("page", F.monotonically_increasing_id()))
        rows = rows.withColumn("__gone", gone).withColumn("index_fingerprint", F.lit(fingerprint)).withColumn("scan_id", F.lit(walk))
        types = dict(spark.createDataFrame([], table.schema).dtypes)
        known = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]
        table.merge(rows.select(*known, "arrival", "__gone"), ["drive_id", "item_id"], (walk, epoch), deleted="__gone")

    return handle


def end_walk(table: LogTable, walk: str) -> None:
    """A full walk is complete: rows that it hasn't seen are gone from the drive.  Once only, however often it is called."""
    table.delete(~F.col("scan_id").eqNullSafe(F.lit(walk)), ("sweep of " + walk, 0))


def signals(notifications: DataFrame, subscriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the state must be that of the notification's own subscription."""
    s = subscriptions.select("subscription_id", F.col("client_state").alias("__want"), "drive_id")
    j = notifications.join(s, "subscription_id", "left").withColumn("__ok", F.coalesce(F.col("client_state") == F.col("__want"), F.lit(False)))
    return j.filter("__ok").select("subscription_id", "drive_id", "received_at"), j.filter("NOT __ok").select("subscription_id", "received_at", F.when(F.col("__want").isNull(), "unknown subscription").otherwise("client state").alias("reason"))


class Retry:
    """Per key: transient failures back off (15 s doubling up to 30 min), permanent ones and the eighth go to the dead letters."""

    def __init__(self, base_s: float = 15.0, most_s: float = 1800.0, attempts: int = 8):
        self.base_s, self.most_s, self.attempts = base_s, most_s, attempts

    def decide(self, attempt: int, outcome: str) -> tuple[str, float]:
        if outcome == "ok":
            return "done", 0.0
        if outcome == "permanent" or attempt >= self.attempts:
            return "dead", 0.0
        return "retry", min(self.most_s, self.base_s * 2 ** (attempt - 1))

    def stateful(self, outcomes: DataFrame) -> DataFrame:
        """Stream of (key, outcome) to (key, attempt, action, delay_s); a settled key's state is dropped.

        A key that waits has a timer: when its delay is over, a row with the action ``redeliver`` says that the next
        attempt is due.
        """
        decide = self.decide

        def step(key, frames, state):
            if state.hasTimedOut:
                attempt = state.get[0]
                state.update((attempt,))
                yield pd.DataFrame([(key[0], attempt, "redeliver", 0.0)], columns=["key", "attempt", "action", "delay_s"])
                return
            attempt = state.get[0] if state.exists else 0
            rows = []
            for f in frames:
                for outcome in f["outcome"]:
                    attempt += 1
                    action, delay = decide(attempt, outcome)
                    rows.append((key[0], attempt, action, delay))
                    if action != "retry":
                        attempt = 0
            if attempt:
                state.update((attempt,))
                state.setTimeoutDuration(max(1, int(1000 * rows[-1][3])))
            elif state.exists:
                state.remove()
            yield pd.DataFrame(rows, columns=["key", "attempt", "action", "delay_s"])

        return outcomes.groupBy("key").applyInPandasWithState(step, "key string, attempt int, action string, delay_s double", "attempt int", "append", "ProcessingTimeTimeout")


def settle_actions(dead_letters: str, queue: str) -> Callable[[DataFrame, int], None]:
    """A batch handler for :meth:`Retry.stateful`: dead keys go to the reject table, due ones back to the request queue.

    The batch's actions are worked out once, and each of the two is one file set under the epoch's number, so a replay adds nothing.
    """

    def handle(actions: DataFrame, epoch: int) -> None:
        actions = actions.persist()
        try:
            written_once(actions.filter("action = 'dead'").select("key", "attempt"), dead_letters, epoch)
            due = actions.filter("action = 'redeliver'").select("key", (F.col("attempt") + 1).alias("attempt"))
            if not due.isEmpty():
                due.write.mode("overwrite").json(f"{queue}/epoch={epoch}")
        finally:
            actions.unpersist()

    return handle


def publish(signal: DataFrame, topic: str) -> None:
    """Append signals (drive_id, sent_at) to a topic folder."""
    signal.select("drive_id", "sent_at").write.mode("append").json(topic)


def consume(spark: SparkSession, topic: str, drives: list[str], checkpoint: str, rejects: str, handle: Callable[[list[str], int], None], trigger_s: float | None = None):
    """Signals of known drives start their pass, once a batch and one batch at a time; others are kept as rejects.

    The drives are the few that this deployment serves, so their names are what comes to the driver.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        known = F.coalesce(F.col("drive_id").isin(*drives), F.lit(False))
        written_once(rows.filter(~known).withColumn("reason", F.lit("wrong drive")), rejects, epoch)
        due = sorted(r["drive_id"] for r in rows.filter(known).select("drive_id").distinct().collect())
        if due:
            handle(due, epoch)

    return delta_pass(spark.readStream.schema("drive_id string, sent_at string").json(topic), checkpoint, batch, trigger_s)


def beat(spark: SparkSession, worker: str, folder: str, checkpoint: str, every_s: int = 30):
    """A worker's heartbeat: one row each period, for as long as the query runs."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.agg(F.max("timestamp").alias("at")).filter("at is not null").select(F.lit(worker).alias("worker"), "at").write.mode("append").json(folder)

    source = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every_s} seconds").start()


def stale(beats: DataFrame, stale_s: int = 120) -> DataFrame:
    """Stream of (worker, at) to (worker, last): workers whose last beat is older than ``stale_s`` in event time, once each silence."""

    def watch(key, frames, state):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="ms"))], columns=["worker", "last"])
            return
        last = max([int(f["at"].max().timestamp() * 1000) for f in frames] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + stale_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["worker", "last"])

    return beats.withWatermark("at", "0 seconds").groupBy("worker").applyInPandasWithState(watch, "worker string, last timestamp", "last long", "append", "EventTimeTimeout")


def once_per_question(ledger: DataFrame, fallback: DataFrame) -> DataFrame:
    """Turn totals for questions without any row of their own."""
    return fallback.join(ledger.select("question_id"), "question_id", "left_anti")


def inherited(child: Column, parent: Column) -> Column:
    """A scope's field, or its parent's."""
    return F.coalesce(child, parent)
