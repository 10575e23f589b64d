import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from korpusa.operators import evaluation as E
from korpusa.operators.keyed_store import KeyedStore
from korpusa.operators.numbering import numbered
from korpusa.streaming.tokens import NEVER, Guard, run_judged

T0 = dt.datetime(2024, 1, 1)


def test_tokens_in_batches_with_late_rows(spark, tmp_path):
    rng, rows = random.Random(8), []
    for i in range(240):
        at = T0 + dt.timedelta(minutes=2 * i, microseconds=rng.randrange(10**6))
        token = rng.randrange(4)
        rows.append((token, at, None, at + dt.timedelta(minutes=rng.choice([0, 5, 60]))) if rng.random() < 0.2 else (token, at, i, None))
    # rows come up to forty minutes late, within the watermark
    rows = [r for _, r in sorted((k + rng.randrange(20), r) for k, r in enumerate(rows))]
    folder = tmp_path / "in"
    for k in range(6):
        part = spark.createDataFrame(rows[40 * k : 40 * k + 40], "token long, ts timestamp, use long, until timestamp")
        part.coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*"):
            if f.stat().st_mtime > 10**9:
                os.utime(f, (1000 + k, 1000 + k))
    got = {(r.use, r.refused) for r in run_judged(spark, str(folder), files=1).collect()}
    want = {(u, any(x[0] == k and x[3] and x[1] <= at < x[3] for x in rows)) for k, at, u, _ in rows if u is not None}
    assert got == want and len({x for _, x in want}) == 2


def test_calls_on_state_do_not_grow_with_rows():
    class Cell:
        def __init__(self, calls, rows):
            self.calls, self.rows = calls, rows

        def __getattr__(self, name):
            def call(*given):
                self.calls.append(name)
                if name == "get":
                    return iter(self.rows) if isinstance(self.rows, list) else self.rows
                if name == "exists":
                    return bool(self.rows)
                if name in ("appendValue", "appendList"):
                    self.rows = self.rows + (given[0] if name == "appendList" else [given[0]])
                elif name in ("put", "update"):
                    self.rows = given[0]
                elif name == "clear":
                    self.rows = [] if isinstance(self.rows, list) else None

            return call

    class Handle:
        def __init__(self):
            self.calls, self.timers = [], []

        def getListState(self, *_):
            return Cell(self.calls, [])

        def getValueState(self, *_):
            return Cell(self.calls, None)

        def registerTimer(self, at):
            self.calls.append("timer")
            self.timers.append(at)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    def run(n):
        guard, handle = Guard(), Handle()
        guard.init(handle)
        rows = pd.DataFrame([(1000 * i, i, NEVER) if i % 7 else (1000 * i, -1, 1000 * i + 2500) for i in reversed(range(1, n))], columns=["at", "use", "until"])
        list(guard.handleInputRows((1,), iter([rows]), Clock(0)))
        out = []
        for ms in (n // 2, 2 * n):  # each watermark fires the timers up to it
            due = [t for t in handle.timers if t <= ms]
            handle.timers = [t for t in handle.timers if t > ms]
            for _ in due:
                out += [x for f in guard.handleExpiredTimer((1,), Clock(ms), None) for x in f.itertuples(index=False, name=None)]
        assert sorted(out) == [(1, i, i > 7 and i % 7 < 3) for i in range(1, n) if i % 7]
        return len(handle.calls)

    assert run(700) == run(70) < 25


def put(spark, rows):
    return spark.createDataFrame([(*r, 0, False) if len(r) == 2 else r for r in rows], "id long, v string, `order` int, gone boolean")


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "s"), "id", "id long, v string", 4)


def held(store):
    return {r.id: r.v for r in store.rows().collect()}


def test_batches_replayed_and_out_of_order(spark, store):
    assert held(store) == {} and store.apply(7, put(spark, [(i, f"a{i}") for i in range(20)] + [(None, "x")]))["imported"] == 20
    assert store.apply(3, put(spark, [(1, "b"), (2, "a2"), (99, "n"), (4, "x", 1, True), (4, "y", 0, False), (77, None, 0, True)])) == {"imported": 1, "updated": 1, "skipped": 1, "deleted": 1, "missing": 1}
    want = {i: f"a{i}" for i in range(20) if i != 4} | {1: "b", 99: "n"}
    assert held(store) == want
    assert store.apply(3, put(spark, [(i, "lost") for i in range(20)]))["updated"] == 1 and held(store) == want
    assert store.apply(8, put(spark, [(i, None, 0, True) for i in want]))["deleted"] == len(want) and held(store) == {}
    assert store.apply(9, put(spark, [(5, None)]))["imported"] == 1 and held(store) == {5: None}
    assert store.apply(10, put(spark, [(5, None)]))["skipped"] == 1


def test_a_failed_batch_is_done_again(spark, store, monkeypatch):
    store.apply(1, put(spark, [(1, "a"), (2, "b")]))
    real = type(spark).createDataFrame

    def fail(self, data, schema=None, **kw):
        if schema == "value string":
            raise RuntimeError("lost driver")
        return real(self, data, schema, **kw)

    monkeypatch.setattr(type(spark), "createDataFrame", fail)
    changes = real(spark, [(1, "c", 0, False)], "id long, v string, `order` int, gone boolean")
    with pytest.raises(RuntimeError):
        store.apply(2, changes)
    monkeypatch.undo()
    assert held(store) == {1: "a", 2: "b"}
    assert store.apply(2, changes)["updated"] == 1 and held(store) == {1: "c", 2: "b"}


def test_sink_of_a_stream(spark, store, tmp_path):
    src = tmp_path / "src"
    for k in range(3):
        put(spark, [(1, f"v{k}"), (k + 10, "n")]).coalesce(1).write.mode("append").parquet(str(src))
        for f in src.glob("part-*"):
            if f.stat().st_mtime > 10**9:
                os.utime(f, (1000 + k, 1000 + k))
    stream = spark.readStream.schema("id long, v string, `order` int, gone boolean").option("maxFilesPerTrigger", 1).parquet(str(src))
    for name in ("one", "two"):  # a lost checkpoint starts from the first batch again
        query = stream.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    assert held(store) == {1: "v2", 10: "n", 11: "n", 12: "n"} and len(store.ledger()) == 3


def test_numbers_of_all_rows(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "id * 7919 % 1000 as v", "'z' as place")
    got = numbered(df, [F.desc("v"), F.asc("id")], "nr").orderBy("nr").collect()
    want = sorted(((i, i * 7919 % 1000) for i in range(5000)), key=lambda r: (-r[1], r[0]))
    assert [(r.nr, r.id, r.v) for r in got] == [(k + 1, *w) for k, w in enumerate(want)]
    assert numbered(df.limit(0), [F.asc("id")], "nr").collect() == []


def test_truth_ids_and_pairs(spark):
    df = spark.createDataFrame([("CHUNK 1, CHUNK 3",), (None,), ("",), ("x 7 y 7",)], "t string")
    assert [r[0] for r in df.select(E.truth_ids("t")).collect()] == [[1, 3], [], [], [7]]
    truths = spark.createDataFrame([(1, [5], {}), (2, [], {"a": "Pasal 1", "b": "x"}), (3, [], {"a": ""}), (4, [9], {}), (5, [], {}), (6, None, None)], "query_id long, ids array<long>, pairs map<string,string>")
    found = spark.createDataFrame([(1, 4, 1, {}), (1, 5, 2, {}), (2, 0, 1, {"a": "PASAL 12"}), (2, 0, 3, {"a": "pasal 1", "b": "yxy"}), (3, 1, 4, {}), (4, 8, 1, {}), (5, 1, 1, {"a": "b"}), (6, 1, 1, None)], "query_id long, chunk long, rank long, meta map<string,string>")
    assert dict(map(tuple, E.matched(found, truths).collect())) == {1: 2, 2: 1, 3: 4, 4: None, 5: None, 6: None}
    got = {r.k: (r.questions, r.hit_rate, r.mrr) for r in E.scores(E.matched(found, truths), (1, 3)).collect()}
    assert got == {1: (6, round(1 / 6, 6), round(1 / 6, 6)), 3: (6, round(2 / 6, 6), round(1.5 / 6, 6))}
