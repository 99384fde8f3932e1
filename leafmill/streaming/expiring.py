"""Keyed state that goes away by itself: rate windows and ticket desks as stateful processors with timers.

A state is kept only while something could still depend on it: a rate window until it has run out, a ticket until its time to
live is over. Timers run on the watermark, which no later row of the stream is older than, so what they take away can't change
a result. Each processor walks its key's rows with the same step as the fold that is its batch twin.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmill.operators.folds import folded
from leafmill.sources.shared import fresh_dir

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """A key's rows of one batch, which the stream's trigger bounds."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable")


# ── rate windows ──


class RateWindows(StatefulProcessor):
    """The open windows of a bucket of clients (key, opened, n): a window opens with a client's first row and with the first one
    after it has run out. A bucket's windows are one value with one timer, so what a batch costs goes by its rows, and not by
    calls for each client."""

    def __init__(self, limit: int, micros: int):
        self.limit, self.micros = limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getValueState("windows", "keys array<long>, opened array<long>, n array<long>")

    def ends(self, opened: int) -> int:
        return -(-(opened + self.micros) // 1000)

    def held(self) -> dict[int | None, tuple[int, int]]:
        return {k: (opened, n) for k, opened, n in zip(*self.windows.get(), strict=True)} if self.windows.exists() else {}

    def put(self, windows: dict[int | None, tuple[int, int]], timer: int | None) -> None:
        """Keeps these windows and a timer for the last of them, in place of the one for `timer`."""
        last = max((self.ends(opened) for opened, _ in windows.values()), default=None)
        if timer != last:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if last is not None:
                self.handle.registerTimer(last)
        if windows:
            self.windows.update((list(windows), *(list(c) for c in zip(*windows.values(), strict=True))))
        else:
            self.windows.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        windows = self.held()
        timer = max((self.ends(opened) for opened, _ in windows.values()), default=None)
        data, allowed, remaining = in_order(rows, "named", "key", "at", "id"), [], []
        clients = [k if named else None for named, k in zip(data["named"].tolist(), data["key"].tolist(), strict=True)]
        for client, at in zip(clients, data["at"].tolist(), strict=True):
            opened, n = windows.get(client, (None, 0))
            if opened is None or at >= opened + self.micros:
                opened, n = at, 0
            n += 1
            windows[client] = opened, n
            allowed.append(n <= self.limit)
            remaining.append(max(0, self.limit - n))
        # no later row is older than the watermark
        now = timerValues.getCurrentWatermarkInMs()
        self.put({k: w for k, w in windows.items() if self.ends(w[0]) > now}, timer)
        yield pd.DataFrame({"key": pd.array(clients, "Int64"), "id": data["id"].to_numpy(), "allowed": allowed, "remaining": remaining})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.put({k: w for k, w in self.held().items() if self.ends(w[0]) > now}, None)
        yield pd.DataFrame({"key": [], "id": [], "allowed": [], "remaining": []}).astype({"key": "int64", "id": "int64", "allowed": "bool", "remaining": "int64"})

    def close(self) -> None:
        pass


def stream_rate_limit(events: DataFrame, limit: int, seconds: int, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """streaming.state.rate_limited() over a stream (key, ts, id); a client's state goes when the watermark has passed its window.
    Clients are dealt into `buckets` by a hash; a bucket's rows of a batch are a task's at a time."""
    with_store(events.sparkSession)
    rows = events.select(F.col("key").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id")).withWatermark("ts", late)
    rows = rows.select(F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNotNull().alias("named"), "ts", "id", F.unix_micros("ts").alias("at"), F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        RateWindows(limit, seconds * 1_000_000), "key long, id long, allowed boolean, remaining long", "Append", "EventTime"
    )


# ── a desk that hands out tickets ──

OUTCOME = "owner long, ord long, ticket string, outcome string, live long"


def at_desk(tickets: dict[str, list], at: int, command: str, ticket: str, ttl: int, most: int) -> str:
    """What a command does at a desk with these tickets ({ticket: [status, born]}, oldest first): those over their time go,
    and, unless a ticket is settled, the oldest while there are more than `most`. A claim is given once; a failed delivery may
    be claimed again."""
    for t in [t for t, (_, born) in tickets.items() if born + ttl <= at]:
        del tickets[t]
    while len(tickets) > most and command in ("create", "claim", "read"):
        del tickets[next(iter(tickets))]
    known = tickets.get(ticket)
    if command == "create":
        tickets[ticket] = ["pending", at]
        return "pending"
    if command == "read":
        return known[0] if known else "expired"
    if not known or (command == "claim" and known[0] != "pending"):
        return "refused"
    known[0] = {"claim": "claimed", "ready": "ready", "error": "pending"}[command]
    return known[0]


def desk(commands: DataFrame, ttl: int = 900, most: int = 32) -> DataFrame:
    """The outcome of each command (owner, ord, at in seconds, command, ticket) in order, and how many tickets are there then. A
    desk holds at most one ticket more than `most`, however many commands it gets."""

    def step(tickets: dict, owner: int, ord_: int, at: int, command: str, ticket: str) -> tuple[dict, tuple]:
        outcome = at_desk(tickets, at, command, ticket, ttl, most)
        return tickets, (owner, ord_, ticket, outcome, len(tickets))

    rows = commands.select(F.col("owner").cast("long").alias("owner"), F.col("ord").cast("long").alias("ord"), F.col("at").cast("long").alias("at"), "command", "ticket")
    return folded(rows, "owner", ["at", "ord"], dict, step, OUTCOME)


class Desks(StatefulProcessor):
    """The tickets of a bucket of desks, oldest first at each; `most` bounds a desk. A bucket's tickets are one value with one
    timer for the youngest, so what a batch costs goes by its rows, and not by calls for each desk."""

    def __init__(self, ttl: int, most: int):
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tickets = handle.getValueState("tickets", "owners array<long>, counts array<long>, tickets array<string>, status array<string>, born array<long>")

    def ends(self, desks: dict[int | None, dict[str, list]]) -> int | None:
        """When the last ticket is over."""
        return max(((born + self.ttl) * 1000 for tickets in desks.values() for _, born in tickets.values()), default=None)

    def held(self) -> dict[int | None, dict[str, list]]:
        if not self.tickets.exists():
            return {}
        owners, counts, *columns = self.tickets.get()
        rows = zip(*columns, strict=True)
        return {owner: {t: [status, born] for t, status, born in islice(rows, n)} for owner, n in zip(owners, counts, strict=True)}

    def put(self, desks: dict[int | None, dict[str, list]], timer: int | None) -> None:
        """Keeps the tickets of these desks and a timer for the last of them, in place of the one for `timer`."""
        desks = {owner: tickets for owner, tickets in desks.items() if tickets}
        last = self.ends(desks)
        if timer != last:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if last is not None:
                self.handle.registerTimer(last)
        if desks:
            rows = [(t, *rest) for tickets in desks.values() for t, rest in tickets.items()]
            self.tickets.update((list(desks), [len(tickets) for tickets in desks.values()], *(list(c) for c in zip(*rows, strict=True))))
        else:
            self.tickets.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        desks = self.held()
        timer, out = self.ends(desks), []
        data = in_order(rows, "named", "owner", "at", "ord")
        for named, owner, order, at, command, ticket in zip(*(data[c].tolist() for c in ("named", "owner", "ord", "at", "command", "ticket")), strict=True):
            owner = owner if named else None
            tickets = desks.setdefault(owner, {})
            outcome = at_desk(tickets, at, command, ticket, self.ttl, self.most)
            out.append((owner, order, ticket, outcome, len(tickets)))
        # no later row is older than the watermark
        now = timerValues.getCurrentWatermarkInMs()
        self.put({owner: self.left(tickets, now) for owner, tickets in desks.items()}, timer)
        found = pd.DataFrame(out, columns=["owner", "ord", "ticket", "outcome", "live"])
        yield found.assign(owner=pd.array([o[0] for o in out], "Int64"))

    def left(self, tickets: dict[str, list], now: int) -> dict[str, list]:
        """A desk's tickets that aren't over yet."""
        return {t: v for t, v in tickets.items() if (v[1] + self.ttl) * 1000 > now}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.put({owner: self.left(tickets, now) for owner, tickets in self.held().items()}, None)
        yield pd.DataFrame({"owner": [], "ord": [], "ticket": [], "outcome": [], "live": []}).astype({"owner": "int64", "ord": "int64", "ticket": "str", "outcome": "str", "live": "int64"})

    def close(self) -> None:
        pass


def stream_desk(commands: DataFrame, ttl: int = 900, most: int = 32, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """desk() over a stream (owner, ts, ord, command, ticket). Desks are dealt into `buckets` by a hash; a bucket's rows of a batch
    and its tickets are a task's at a time."""
    with_store(commands.sparkSession)
    rows = commands.select(F.col("owner").cast("long").alias("owner"), F.col("ts").cast("timestamp").alias("ts"), F.col("ord").cast("long").alias("ord"), "command", "ticket").withWatermark("ts", late)
    rows = rows.select(F.coalesce("owner", F.lit(0)).alias("owner"), F.col("owner").isNotNull().alias("named"), "ts", "ord", "command", "ticket", F.unix_seconds("ts").alias("at"), F.pmod(F.xxhash64("owner"), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(Desks(ttl, most), OUTCOME, "Append", "EventTime")


# ── streams in the order of time ──


def with_store(spark: SparkSession) -> None:
    """Stateful processors need a state store with timers; a setting of the caller's stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(key, STORE)


def segmented(rows: DataFrame, time: str, segments: int) -> DataFrame:
    """A table as a stream in the order of time: written once as a log of segments, each later than the one before, and read a
    segment a batch."""
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "log")
    ends = rows.agg(F.min(F.unix_micros(F.col(time).cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col(time).cast("timestamp"))).alias("b")).first()
    width = max(1, -(-((ends.b or 0) - (ends.a or 0) + 1) // segments))
    number = F.floor((F.unix_micros(F.col(time).cast("timestamp")) - (ends.a or 0)) / width).cast("int")
    dealt = rows.withColumn("segment", number).repartition("segment")
    # groups of rows of bounded size, so that more than one task reads a segment
    dealt.write.option("parquet.block.size", 8 << 20).partitionBy("segment").parquet(f"{path}/parts")
    # the file source goes by the files' times, so a segment's folder is made known after the one before it
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    p, stamp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, 1_600_000_000_000
    for k in range(segments):
        folder = p(f"{path}/parts/segment={k}")
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                fs.setTimes(status.getPath(), stamp + 60_000 * k, -1)
    return spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/parts").drop("segment")
