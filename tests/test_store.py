"""Commits over several tables: what readers see when a writer dies or comes second, and streams that change tables once."""

import threading

import pytest
from pyspark.sql import functions as F

from leafmill.sources import shared, store
from leafmill.streaming import expiring


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def tables(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.commit(s.snapshot(), {"a": spark.range(3), "b": spark.range(10, 12)})
    return s


def test_commit_and_conflict(spark, tables):
    first = tables.snapshot()
    assert rows(tables.read("a")) == [(0,), (1,), (2,)] and first.number == 1
    tables.commit(first, {"a": spark.range(1)}, {"b": spark.range(12, 13)})
    assert rows(tables.read("a")) == [(0,)] and rows(tables.read("b")) == [(10,), (11,), (12,)]
    assert rows(tables.read("a", first)) == [(0,), (1,), (2,)]  # a reader that began before goes on with what it saw
    with pytest.raises(store.Conflict):
        tables.commit(first, {"a": spark.range(5)})
    assert tables.snapshot().number == 2 and rows(tables.read("a")) == [(0,)]


@pytest.mark.parametrize("dies_at", [1, 2, 3])
def test_a_writer_that_dies_leaves_the_old_state(spark, tables, monkeypatch, dies_at):
    """After the first table, after the second, or before the manifest has its name."""
    steps = []

    def count(real):
        def step(*args, **more):
            steps.append(real)
            if len(steps) == dies_at:
                raise KeyboardInterrupt
            return real(*args, **more)

        return step

    monkeypatch.setattr(tables, "written", count(tables.written))
    monkeypatch.setattr(store, "create_complete", count(store.create_complete))
    with pytest.raises(KeyboardInterrupt):
        tables.commit(tables.snapshot(), {"a": spark.range(1)}, {"b": spark.range(12, 13)})
    assert rows(tables.read("a")) == [(0,), (1,), (2,)] and rows(tables.read("b")) == [(10,), (11,)]
    monkeypatch.undo()
    tables.commit(tables.snapshot(), {"a": spark.range(1)})
    tables.vacuum(keep=1)
    assert rows(tables.read("a")) == [(0,)] and rows(tables.read("b")) == [(10,), (11,)]
    assert len(shared.names_in(spark, f"{tables.path}/a")) == 1 and tables.numbers() == [2]


def test_writers_at_once(spark, tables):
    """Each adds one to what it reads; none is lost."""
    s = tables
    s.commit(s.snapshot(), {"n": spark.createDataFrame([(0,)], "n long")})
    errors = []

    def add():
        try:
            s.transact(lambda at: {"replaced": {"n": s.read("n", at).select((F.col("n") + 1).alias("n"))}}, tries=30)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and rows(s.read("n")) == [(4,)] and s.snapshot().number == 6


def test_one_of_many_creates(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append((shared.create_complete(spark, f"file://{tmp_path}/x/one", f"{k}" * 999), k))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner = [k for ok, k in won if ok]
    assert len(winner) == 1 and shared.read_small(spark, f"file://{tmp_path}/x/one") == f"{winner[0]}" * 999 and shared.names_in(spark, f"file://{tmp_path}/x") == ["one"]


def test_replayed_batches_change_nothing(spark, tables):
    take = store.each_batch_once(tables, "events", store.keep_latest(tables, "latest", ["key"], "ord"))
    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "key long, ord long, kind string")
    take(one, 0)
    before = tables.snapshot()
    take(one, 0)
    assert tables.snapshot() == before
    take(spark.createDataFrame([(1, 5, "d"), (1, 4, "x")], "key long, ord long, kind string"), 1)
    assert rows(tables.latest("latest", ["key"], "ord")) == [(1, 5, "d"), (2, 3, "c")] and len(tables.snapshot().tables["latest"]) == 2
    tables.compact("latest", ["key"], "ord")
    assert rows(tables.read("latest")) == [(1, 5, "d"), (2, 3, "c")] and tables.snapshot().batches == {"events": 1}


def test_stream_with_a_crash_between_batches(spark, tables, tmp_path):
    """The batch that failed comes again when the stream starts anew, also if its commit was made."""
    events = spark.createDataFrame([(k % 7, k, k * 1000) for k in range(200)], "key long, ord long, at long").withColumn("ts", F.timestamp_millis("at")).drop("at")
    stream = expiring.segmented(events, "ts", 4)
    take = store.each_batch_once(tables, "events", store.keep_latest(tables, "latest", ["key"], "ord"))

    def run(sink):
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    def dies_after_commit(df, number):
        take(df, number)
        if number == 1:
            raise RuntimeError("after the commit")

    with pytest.raises(Exception, match="after the commit"):
        run(dies_after_commit)
    seen = []
    run(lambda df, number: (seen.append(number), take(df, number)))
    assert seen[0] == 1 and tables.snapshot().batches == {"events": 3} and len(tables.snapshot().tables["latest"]) == 4
    want = {(k, max(o for o in range(200) if o % 7 == k)) for k in range(7)}
    assert {(r.key, r.ord) for r in tables.latest("latest", ["key"], "ord").collect()} == want
    assert {r.key for r in store.replay(tables, "latest", "key", F.timestamp_millis(F.lit(230_000))).collect()} == {k for k, o in want if o >= 200} | set()
    assert {r.key for r in store.replay(tables, "latest", "key", F.timestamp_millis(F.lit(225_000))).collect()} == {k for k, o in want if o >= 195}


def test_stale_versions_are_answered(spark, tables):
    take = store.each_batch_once(tables, "marks", store.compare_and_set_batch(tables, "marks", "verdicts"))
    schema = "key long, ord long, expected long, value string"
    take(spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b"), (2, 3, 0, "c")], schema), 0)
    take(spark.createDataFrame([(1, 4, 1, "d"), (1, 5, 2, "e"), (2, 6, 0, "f"), (3, 7, 5, "g")], schema), 1)
    got = {r.ord: (r.status, r.version, r.value) for r in tables.read("verdicts").collect()}
    assert got == {1: (200, 1, "a"), 2: (409, 1, "a"), 3: (200, 1, "c"), 4: (200, 2, "d"), 5: (200, 3, "e"), 6: (409, 1, "c"), 7: (409, 0, None)}
    assert {(r.key, r.version, r.value) for r in tables.latest("marks", ["key"], "version").collect()} == {(1, 3, "e"), (2, 1, "c")}
