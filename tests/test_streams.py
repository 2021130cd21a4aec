"""Streams against the same on tables: out of order, replayed, late, and stopped in between."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codicil.operators import manifest as M
from codicil.streaming import events as E


def put(spark, path, rows):
    d = spark.createDataFrame([(i, t, u, "view", 1.0, "{}") for i, t, u in rows], "event_id long, s double, user_id long, event_type string, value double, props string")
    d.select("event_id", F.timestamp_micros((F.col("s") * 10**6).cast("long")).alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(path)


def some_events(seed=4):
    dealt, rows = random.Random(seed), []
    for user in range(6):
        t = 1000.0
        for k in range(40):
            t += dealt.choice([0, 0.0005, 3.25, 10, 29.9999, 30, 30.5, 200])
            rows.append((100 * user + k, t, user))
    return sorted(rows, key=lambda r: r[1])


def test_ticks_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = some_events()
    a, b, c = rows[:90], rows[90:170], rows[170:]
    src = f"{tmp_path}/in"
    run = lambda: E.append_all(E.active_ticks(E.event_stream(spark, src), "1 minute"), f"{tmp_path}/ticks", f"{tmp_path}/cp")
    random.Random(1).shuffle(a)
    put(spark, src, a)
    run()
    so_far = spark.read.parquet(f"{tmp_path}/ticks").count()
    put(spark, src, [*b, *b[-5:]])  # the restart finds events of which some come twice
    run()
    put(spark, src, c)
    run()
    put(spark, src, [(9999, 10.0, 3), (9998, 90_000.0, 77), (9997, 90_000.0, None)])  # one far too late, one that ends the wait of all others, and nobody's
    run()
    ticks = spark.read.parquet(f"{tmp_path}/ticks").filter("user_id <> 77")
    got = {r.user_id: (r.last, r.n) for r in ticks.groupBy("user_id").agg(F.max("active_seconds").alias("last"), F.count_distinct("tick").alias("n")).collect()}
    put(spark, f"{tmp_path}/whole", rows)
    want = {r.user_id: r.active_seconds for r in E.active_time(spark.read.parquet(f"{tmp_path}/whole")).collect()}
    assert {u: last for u, (last, _) in got.items()} == want
    assert all(last == 10 * n for last, n in got.values()) and ticks.count() == sum(n for _, n in got.values())  # each tick once
    assert 0 < so_far < ticks.count()


def test_replayed_and_late_files_change_nothing(spark, tmp_path):
    src, path, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    last_of_each = lambda d: M.upsert(d, ["particulars"])
    taken = []

    def run():
        rows = E.once(E.event_stream(spark, src, 100), "10 seconds").selectExpr("event_id AS seq", "cast(user_id AS string) AS document_id", "event_type AS particulars", "event_type AS status")
        taken.append(E.ingest(rows, last_of_each, path, cp))
        number = max(n for n in taken if n is not None)
        return sorted(map(tuple, E.ingested(spark, rows.schema, last_of_each, path, number).collect()))

    rows = some_events(5)
    put(spark, src, rows)
    first = run()
    assert len(first) == 6
    end = rows[-1][1]
    put(spark, src, rows[-3:])  # the same again
    assert run() == first
    put(spark, src, [(10**6, 5.0, 1)])  # a later number, but from long ago
    assert run() == first
    put(spark, src, [(10**6 + 1, end + 1, 1)])
    assert run() != first


def test_ids_are_forgotten_once_they_are_too_old(spark, tmp_path):
    src = f"{tmp_path}/in"
    held = []
    for k in range(4):
        put(spark, src, [(1000 * k + i, 10_000.0 * k + i, i) for i in range(50)])
        q = E.once(E.event_stream(spark, src), "10 seconds").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        held += [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators][-1:]
    assert len(held) == 4 and max(held) <= 50


def test_a_broken_table_is_an_error(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").selectExpr("CASE WHEN id >= 0 THEN raise_error('broken') END AS id").groupBy("id").count()
    with pytest.raises(Exception, match="broken|USER_RAISED"):
        E.run_to_table(stream, "broken").collect()


def test_ticks_ask_the_state_a_few_times_for_any_number_of_events():
    calls = []

    class State:
        def __init__(self):
            self.value = None

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self, "_" + name)

        def _get(self):
            return iter(self.value or []) if isinstance(self.value, list | None) and self.many else self.value

        def _update(self, value):
            self.value = value

        def _put(self, values):
            self.value = list(values)

        def _appendList(self, values):
            self.value = (self.value or []) + list(values)

        def _clear(self):
            self.value = None

    class Handle:
        def getListState(self, *_):
            s = State()
            s.many = True
            return s

        def getValueState(self, *_):
            s = State()
            s.many = False
            return s

        def registerTimer(self, at):
            calls.append(at)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 6_000_000

    ticks = E._Ticks()
    ticks.init(Handle())
    at = [n * 10**6 for n in range(10_000)]
    rows = pd.DataFrame({"at": [*reversed(at), 0], "event_id": [*reversed(range(10_000)), 0]})
    assert list(ticks.handleInputRows((7,), iter([rows]), Times())) == []
    (out,) = ticks.handleExpiredTimer((7,), Times(), None)
    assert out["active_seconds"].tolist() == list(range(10, 6001, 10)) and set(out["user_id"]) == {7}
    left = [tuple(x) for v in ticks._waiting.get() for x in np.frombuffer(v[0], np.int64).reshape(-1, 2).tolist()]
    assert left == [(n * 10**6, n) for n in range(6001, 10_000)]
    assert len(calls) < 15
