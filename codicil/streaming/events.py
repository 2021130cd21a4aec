"""Reading activity: active time, usage, search funnel, backlog; the same functions on tables and on streams."""

from __future__ import annotations

import contextlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from codicil.sources.shared import shared_path

#: A reader is active for so many seconds after an event; active time counts in ticks.
IDLE_SECONDS, TICK_SECONDS = 30, 10
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def active_time(events: DataFrame) -> DataFrame:
    """(user_id, active_seconds): time to a user's next event, up to 30 seconds each; the last event counts for 30."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.lead(at).over(w) - at
    seconds = F.least(F.coalesce(gap, F.lit(10**12)), F.lit(IDLE_SECONDS * 10**6))
    per_user = events.select("user_id", seconds.alias("_us")).groupBy("user_id").agg(F.sum("_us").alias("_us"))
    return per_user.select("user_id", (F.floor(F.col("_us") / (TICK_SECONDS * 10**6)) * TICK_SECONDS).alias("active_seconds"))


#: Events in one value of the state.
STATE_EVENTS = 4096


class _Ticks(StatefulProcessor):
    """Active time of one user, tick by tick.

    Events wait until the watermark has passed them and are then taken in order, so that files may come in any order
    within the lateness.  A timer stands at the earliest that waits, or 30 seconds after the last one taken.  What
    waits is kept as a list of values of many events each, so a batch asks the state a few times a user, not for each event.
    """

    def init(self, handle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "events binary")
        self._done = handle.getValueState("done", "last long, open boolean, active long, ticks long")

    def _wake_at(self, at: int) -> None:
        self._handle.registerTimer(-(-at // 1000))

    @staticmethod
    def _packed(events: np.ndarray) -> list[tuple[bytes]]:
        """Rows of time and event_id as values of the state."""
        return [(np.ascontiguousarray(events[k : k + STATE_EVENTS]).tobytes(),) for k in range(0, len(events), STATE_EVENTS)]

    def handleInputRows(self, key, rows, timerValues):
        least = None
        for d in rows:
            if len(d):
                self._waiting.appendList(self._packed(d[["at", "event_id"]].to_numpy(np.int64)))
                least = int(d["at"].min()) if least is None else min(least, int(d["at"].min()))
        if least is not None:
            self._wake_at(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, idle = timerValues.getCurrentWatermarkInMs() * 1000, IDLE_SECONDS * 10**6
        parts = [np.frombuffer(v[0], np.int64).reshape(-1, 2) for v in self._waiting.get()]
        last, unfinished, active, ticks = self._done.get() or (0, False, 0, 0)
        left = None
        if parts:
            waiting = np.unique(np.concatenate(parts), axis=0)  # by time; one that comes again counts once
            n = int(np.searchsorted(waiting[:, 0], passed, side="right"))
            if n:
                at = waiting[:n, 0]
                active += int(np.minimum(np.diff(at), idle).sum()) + (min(int(at[0]) - last, idle) if unfinished else 0)
                last, unfinished = int(at[-1]), True
                self._waiting.clear()
                if n < len(waiting):
                    self._waiting.put(self._packed(waiting[n:]))
            left = int(waiting[n, 0]) if n < len(waiting) else None
        if unfinished and last + idle <= passed:
            active, unfinished = active + idle, False
        now = active // (TICK_SECONDS * 10**6)
        self._done.update((last, unfinished, active, now))
        if unfinished:
            self._wake_at(last + idle)
        if left is not None:
            self._wake_at(left)
        if now > ticks:
            tick = np.arange(ticks + 1, now + 1)
            yield pd.DataFrame({"user_id": key[0], "tick": tick, "active_seconds": tick * TICK_SECONDS})


def active_ticks(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(user_id, tick, active_seconds) of a stream: a row each time that a user's active time reaches another ten seconds.

    A user's last row has what active_time() gives for the events that the watermark has passed, and 30 seconds after
    them.  Events of a user go by ts and event_id; one that comes again while it waits counts once; those that come
    later than `late` are left out; rows without a user or time have no activity.  State: one row a user and the events of `late`.
    """
    d = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(0)).alias("event_id"))
    return d.groupBy("user_id").transformWithStateInPandas(_Ticks(), "user_id long, tick long, active_seconds long", "Append", "EventTime")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream's events without those that come again, by event_id, and without those later than `late`.  State: the ids of `late`."""
    # a stream's first watermark is 1970, so time is told 2,000 years on: else earlier events would all be late
    moved = events.withColumn("_at", F.col("ts") + F.expr("INTERVAL 730485 DAY")).withWatermark("_at", late)
    return moved.dropDuplicatesWithinWatermark(["event_id"]).drop("_at")


@contextlib.contextmanager
def timers_kept(spark: SparkSession):
    """Streams started within keep their state where timers can be kept."""
    name, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def append_all(result: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an appending stream over all that is there and adds its rows to the files of a path; a restart goes on from the checkpoint."""
    with timers_kept(result.sparkSession):
        q = result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def active_sessions(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): sessions whose gaps are 30 seconds at most.  For tables and streams."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    s = d.groupBy("user_id", F.session_window("ts", f"{IDLE_SECONDS} seconds").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def usage(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, value): events per window and type.  For tables and streams."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    g = d.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "n_values")


def funnel(events: DataFrame, submitted: str = "click", completed: str = "view", selected: str = "purchase") -> DataFrame:
    """(day, submitted, completed, selected): users per day that came so far, each step after the one before."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    u = events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(first(submitted).alias("a"), F.max(F.when(F.col("event_type") == completed, F.col("ts"))).alias("b"), F.max(F.when(F.col("event_type") == selected, F.col("ts"))).alias("c"))
    done = F.coalesce(F.col("b") > F.col("a"), F.lit(False))
    return u.groupBy("day").agg(F.count("a").alias("submitted"), F.count_if(done).alias("completed"), F.count_if(done & F.coalesce(F.col("c") > F.col("a"), F.lit(False))).alias("selected"))


def enriched(events: DataFrame, readers: DataFrame, platform: str = "web") -> DataFrame:
    """Events with a constant platform and the reader's attributes: a left join with a table, for streams too."""
    return events.join(readers, "user_id", "left").withColumn("platform", F.lit(platform))


def backlog(messages: DataFrame) -> DataFrame:
    """(kind, unread): messages not read yet."""
    return messages.groupBy("kind").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_to_table(result: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over all that is there and returns its last complete result as a table.

    Each batch replaces the table of the batch before by one of its own number, so a batch that is run again
    after a failure gives the same table.
    """
    spark = result.sparkSession
    path = shared_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    q = result.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    number = (q.lastProgress or {}).get("batchId", 0)
    while True:  # the last trigger may have had no data and so no batch
        try:
            return spark.read.schema(result.schema).parquet(f"{path}/table/batch={number}")
        except AnalysisException as e:
            if number <= 0 or e.getCondition() != "PATH_NOT_FOUND":
                raise
            number -= 1


def live_runs(number: int) -> list[int]:
    """The batches whose runs make up the table after batch `number`, oldest first: one for each bit of number + 1."""
    runs, left = [], number + 1
    while left:
        runs.insert(0, left - 1)
        left &= left - 1
    return runs


def ingest(stream: DataFrame, upsert, path: str, checkpoint: str) -> int | None:
    """A restartable upsert: the table is kept as runs path/batch=n, read it with ingested().

    upsert(rows) gives the rows that stay, and may be applied to a part of the rows before it is to all.  Batch n
    takes up the runs that it makes superfluous, those of 1, 2, 4, ... batches before it, so a row is written
    again as often as the number of batches doubles, not with each batch.  What a batch reads is told by its number
    alone, so one that is run again after a failure writes the same.  Returns the number of the last batch
    written, None if there was nothing new.
    """
    spark = stream.sparkSession
    written: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        rows, kept = batch, live_runs(number)
        for run in [r for r in live_runs(number - 1) if r not in kept]:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/batch={run}").unionByName(rows)
        upsert(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
        written.append(number)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return written[-1] if written else None


def ingested(spark: SparkSession, schema, upsert, path: str, number: int) -> DataFrame:
    """The table that ingest() left after batch `number`."""
    runs = spark.read.schema(schema).parquet(*[f"{path}/batch={run}" for run in live_runs(number)])
    return upsert(runs).select(*runs.columns)
