"""State that goes away: streams in several batches against their batch twins, and how much state is left."""

import datetime
import random

from pyspark.sql import functions as F

from leafmill.streaming import expiring, state

START = datetime.datetime(2024, 1, 1)


def kept(stream, path):
    """The rows of a stream that has run to its end, and the state's rows after each batch."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.parquet(f"{path}/out").collect(), sizes


def test_rate_windows_are_swept(spark, tmp_path):
    rng, rows = random.Random(2), []
    for client in range(240):  # each is seen for some minutes only
        for _ in range(rng.randint(1, 6)):
            rows.append((client, START + datetime.timedelta(minutes=client * 5 + rng.randint(0, 9)), len(rows)))
    df = spark.createDataFrame(rows, "key long, ts timestamp, id long")
    want = {(r.key, r.id, r.allowed, r.remaining) for r in state.rate_limited(df, 2, 300).collect()}
    got, sizes = kept(expiring.stream_rate_limit(expiring.segmented(df, "ts", 6), 2, 300, late="10 minutes"), f"file://{tmp_path}")
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    # a window and its timer for each of the clients of a batch at most, not for all there were
    assert len(sizes) >= 6 and max(sizes) < 3 * 240 / 6 * 1.5 and sizes[-1] <= sizes[0] * 1.5


def test_desks_are_swept_and_bounded(spark, tmp_path):
    rng, rows = random.Random(5), []
    for owner in range(20):
        for k in range(60):
            command = rng.choice(["create", "create", "claim", "ready", "error", "read"])
            ticket = f"t{k}" if command == "create" else f"t{max(0, k - rng.randint(1, 6))}"
            rows.append((owner, START + datetime.timedelta(seconds=owner * 7200 + k * rng.choice([5, 20])), len(rows), command, ticket))
    df = spark.createDataFrame(rows, "owner long, ts timestamp, ord long, command string, ticket string")
    want = {tuple(r) for r in expiring.desk(df.withColumn("at", F.unix_seconds("ts")), ttl=300, most=8).collect()}
    assert max(r[4] for r in want) == 9 and {r[3] for r in want} == {"pending", "claimed", "ready", "refused", "expired"}
    got, sizes = kept(expiring.stream_desk(expiring.segmented(df, "ts", 5), ttl=300, most=8, late="1 minute"), f"file://{tmp_path}")
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert max(sizes) <= 20 * 3  # at most a list, its size and a timer a desk


def test_a_desk_step_by_step():
    tickets = {}
    for moment, command, ticket, want in [
        (0, "create", "a", "pending"), (1, "claim", "a", "claimed"), (2, "claim", "a", "refused"), (3, "error", "a", "pending"), (4, "claim", "a", "claimed"), (5, "ready", "a", "ready"),
        (6, "read", "a", "ready"), (7, "claim", "x", "refused"), (900, "ready", "a", "refused"), (900, "read", "a", "expired"),
    ]:
        assert expiring.at_desk(tickets, moment, command, ticket, 900, 32) == want
    for k in range(40):
        expiring.at_desk(tickets, 1000, "create", f"t{k}", 900, 32)
    assert len(tickets) == 33 and expiring.at_desk(tickets, 1000, "read", "t7", 900, 32) == "expired" and list(tickets)[0] == "t8"
