"""Positions on a script's clock against loops, and plans without pair joins."""

import random

from pyspark.sql import functions as F

from leafmill.operators import timeline
from leafmill.plans.catalogue import QUERIES
from leafmill.streaming import state

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]


def located_by_hand(lengths, seconds):
    starts, total = [], 0.0
    for length in lengths:
        starts.append(total)
        total += max(0.0, length or 0.0)
    t = max(0.0, min(seconds or 0.0, max(0.0, total - 0.25)))
    seq = max(i for i, s in enumerate(starts) if s <= t)
    return seq, max(0.0, min(t - starts[seq], max(0.0, max(0.0, lengths[seq] or 0.0) - 0.25)))


def test_located_by_hand(spark):
    rng = random.Random(3)
    scripts = {k: [rng.choice([0.0, None, -1.0, 2.0, 0.5, 7.25]) for _ in range(rng.randint(1, 9))] for k in range(30)}
    points = [(k, s) for k in scripts for s in (-3.0, None, 0.0, 2.0, 2.5, 7.25, 9.5, 1e6)] + [(99, 1.0)]
    segments = spark.createDataFrame([(k, i, d) for k, ds in scripts.items() for i, d in enumerate(ds)], "script long, seq long, duration double")
    df = timeline.located(segments.repartition(3), spark.createDataFrame(points, "script long, seconds double"))
    assert plan(df).count("Exchange hashpartitioning") == 1
    got = {(r.script, r.seconds): (r.seq, round(r.offset, 9)) for r in df.collect()}
    assert got == {(k, s): (lambda at: (at[0], round(at[1], 9)))(located_by_hand(scripts[k], s)) for k, s in points if k in scripts}


def test_places_one_after_another(spark):
    segments = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 2, 3.0)], "script long, seq long, duration double")
    places = spark.createDataFrame([(1, 0, -1.0), (1, 2, 1.5), (1, 7, 2.0), (2, 0, None)], "script long, seq long, offset double")
    assert sorted((r.script, r.seq, r.seconds) for r in timeline.position_of(segments, places).collect()) == [(1, 0, 0.0), (1, 2, 3.5), (1, 7, 2.0), (2, 0, 0.0)]
    assert sorted((r.seq, r.next_seq) for r in timeline.passages(segments).collect()) == [(0, 1), (1, 2), (2, None)]


def test_epochs_by_hand(spark):
    rng = random.Random(8)
    rows = [(i * 700, rng.choices(["invalidate", "forget", "reset", "drop"], [5, 2, 1, 3])[0], rng.randrange(12)) for i in range(300)]
    epochs, known = {}, set()
    for _, kind, article in rows:
        if kind in ("invalidate", "forget"):
            epochs[article] = epochs.get(article, 0) + 1
            known.add(article)
        elif kind == "reset":
            for a in known:
                epochs[a] += 1
    df = state.article_epochs(spark.createDataFrame(rows, "ord long, kind string, article_id long"))
    assert {r.article_id: r.epoch for r in df.collect()} == epochs and df.schema["epoch"].dataType.simpleString() == "bigint"
    quiet = state.article_epochs(spark.createDataFrame([(1, "forget", 5)], "ord long, kind string, article_id long"))
    assert [(r.article_id, r.epoch) for r in quiet.collect()] == [(5, 1)]


def test_no_pairs_in_the_plans(spark):
    for name in ("timeline_locate", "legacy_position"):
        assert "Join" not in plan(QUERIES[name](spark, SF))
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id as ord", "'forget' as kind", "user_id as article_id")
    text = plan(state.article_epochs(e))
    assert "CartesianProduct" not in text and text.count("BroadcastNestedLoopJoin") == 1  # the one row of totals
    assert QUERIES["kept_sessions"](spark, SF).count() > 0
