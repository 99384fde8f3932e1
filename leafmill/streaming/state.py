"""Keyed state: rate windows, leases, guards, tickets, queues. Batch forms are folds and windows by key; streaming forms keep
the same state in Structured Streaming and are checked against them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.cache import running_before
from leafmill.operators.folds import folded
from leafmill.sources.shared import fresh_dir

Column = F.Column


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def rate_limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Each event (key, ts, id) with whether its client's window lets it in. A window opens with the client's first event and
    with the first one after it has run out; it isn't aligned to the clock."""
    micros_ = seconds * 1_000_000

    def step(state: tuple, key: object, ident: int, at: int) -> tuple:
        opened, n = state
        if opened is None or at >= opened + micros_:
            opened, n = at, 0
        n += 1
        return (opened, n), (key, ident, n <= limit, max(0, limit - n))

    rows = events.select("key", F.col("id").cast("long").alias("id"), micros("ts").alias("at"))
    return folded(rows, "key", ["at", "id"], lambda: (None, 0), step, f"key {events.schema['key'].dataType.simpleString()}, id long, allowed boolean, remaining int")


def leases(beats: DataFrame, seconds: int = 30) -> DataFrame:
    """Leases (key, start, until, beats) renewed by heartbeats (key, ts): a new one where the last ran out."""
    s = F.session_window("ts", f"{seconds} seconds")
    return beats.groupBy("key", s.alias("w")).agg(F.count(F.lit(1)).alias("beats")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("until"), "beats")


def guarded_by_generation(events: DataFrame) -> DataFrame:
    """Events (key, ord, generation) that aren't of an older generation than one seen before."""
    w = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_m", F.max("generation").over(w)).where(F.col("_m").isNull() | (F.col("generation") >= F.col("_m"))).drop("_m")


def committed_in_time(jobs: DataFrame, epochs: DataFrame) -> DataFrame:
    """Finished jobs (id, key, epoch) whose key's epoch hasn't moved on; later ones are dropped, keys without one were never touched."""
    j = jobs.join(epochs.select("key", F.col("epoch").alias("_now")), "key", "left")
    return j.where(F.col("epoch") == F.coalesce("_now", F.lit(0))).drop("_now")


def latest(events: DataFrame, now: Column, ttl: int = 30) -> DataFrame:
    """The last event (key, ts, id, kind) of each key, where it isn't older than the replay window."""
    last = events.groupBy("key").agg(F.max_by(F.struct("id", "kind", "ts"), F.struct("ts", "id")).alias("e"))
    return last.select("key", "e.id", "e.kind", "e.ts").where(F.col("ts") >= now - F.expr(f"interval {ttl} seconds"))


def debounced(events: DataFrame, millis: int = 800) -> DataFrame:
    """Events (key, ts, id) that no other of the key follows within the pause."""
    nxt = F.lead("ts").over(Window.partitionBy("key").orderBy("ts", "id"))
    return events.withColumn("_n", nxt).where(F.col("_n").isNull() | (micros("_n") - micros("ts") > millis * 1000)).drop("_n")


def kept_sessions(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Demand sessions (session, article_id, ord) that stand after what has happened (ord, kind, session, article_id): `drop` ends
    one session, `invalidate` and `forget` all of an article, `reset` all there are. Later sessions aren't touched."""
    one = events.where("kind = 'drop'").groupBy("session").agg(F.max("ord").alias("_a"))
    of_article = events.where("kind in ('invalidate', 'forget')").groupBy("article_id").agg(F.max("ord").alias("_b"))
    all_ = events.where("kind = 'reset'").agg(F.max("ord").alias("_c"))  # one row
    j = sessions.join(one, "session", "left").join(of_article, "article_id", "left").crossJoin(F.broadcast(all_))
    return j.where(F.col("ord") > F.coalesce(F.greatest("_a", "_b", "_c"), F.lit(-1))).select(*sessions.columns)


def article_epochs(events: DataFrame) -> DataFrame:
    """How often each article has been invalidated (also by being forgotten); a reset counts for those known before it. Resets
    are counted up to each article's first time in one order of both, by parts of 65,536 events."""
    known = events.where("kind in ('invalidate', 'forget')").groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    both = known.withColumn("reset", F.lit(0)).unionByName(events.where("kind = 'reset'").select("ord", F.lit(1).alias("reset")), allowMissingColumns=True)
    resets = both.agg(F.coalesce(F.sum("reset"), F.lit(0)).alias("resets"))  # one row
    counted = running_before(both, F.floor(F.col("ord") / 65_536), ["ord", F.desc("reset")], "reset", "before").where("reset = 0")
    return counted.crossJoin(F.broadcast(resets)).select("article_id", (F.col("n") + F.col("resets") - F.col("before")).alias("epoch"))


def bounded_lru(accesses: DataFrame, most: int = 24) -> DataFrame:
    """Accesses (ord, key) of a memory that keeps the `most` keys used last, by the keys that it holds in the end, oldest first."""
    last = accesses.groupBy("key").agg(F.max("ord").alias("used")).orderBy(F.desc("used")).limit(most)
    return last.withColumn("place", F.row_number().over(Window.orderBy("used")))  # `most` rows


def attempts_within(attempts: DataFrame, deadline: float, each: float, most: int = 3) -> DataFrame:
    """Attempts (call, n, took, wait, ok, retryable) that are made under a shared deadline: a call goes on while its attempts
    fail in a way that may pass, the pause before the next fits, and none was the last; one is cut at its own limit or where
    the deadline is."""
    w = Window.partitionBy("call").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.least("took", F.lit(each)) + F.col("wait")).over(w), F.lit(0.0))
    over = F.coalesce(F.max((F.col("ok") & (F.col("took") <= each)) | ~F.col("retryable")).over(w), F.lit(False))
    made = attempts.withColumn("_s", spent).withColumn("_o", over).where(~F.col("_o") & (F.col("n") <= most) & (F.col("_s") < deadline))
    cut = F.least(F.lit(each), F.lit(deadline) - F.col("_s"))
    return made.select("call", "n", F.col("_s").alias("started"), F.least(F.col("took"), cut).alias("ran"), F.when(F.col("took") > cut, "timeout").when(F.col("ok"), "ok").otherwise("failed").alias("outcome"))


def stalls(events: DataFrame, seconds: int = 12) -> DataFrame:
    """Gaps (key, since, ts, gap) longer than the threshold between a key's successive events."""
    prev = F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "id"))
    gaps = events.withColumn("since", prev).withColumn("gap", (micros("ts") - micros("since")) / 1e6)
    return gaps.where(F.col("gap") > seconds).select("key", "since", "ts", "gap")


def coalesced(events: DataFrame, seconds: int = 5) -> DataFrame:
    """The last value (key, bucket, value) a key writes in each window of seconds."""
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)
    return events.groupBy("key", bucket.alias("bucket")).agg(F.max_by("value", F.struct("ts", "id")).alias("value"))


def timing(samples: DataFrame, last: int = 50) -> DataFrame:
    """Of samples (key, ord, ms): count, rounded mean and greatest over all, median and 95th nearest rank over the last ones."""
    r = samples.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ord"))))
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    tail = F.sort_array(F.collect_list(F.when(F.col("_r") <= last, F.col("ms"))))
    g = r.groupBy("key").agg(F.count(F.lit(1)).alias("count"), half_up(F.avg("ms")).alias("mean"), half_up(F.max("ms")).alias("max"), tail.alias("t"))
    n = F.size("t")
    pick = lambda i: half_up(F.element_at("t", i.cast("int") + 1))
    return g.select("key", "count", "mean", "max", pick(F.floor(n / 2)).alias("p50"), pick(F.least(n - 1, F.floor(n * 0.95))).alias("p95"))


def queue_stats(log: DataFrame) -> DataFrame:
    """Counters and waits over a queue's log (kind, wait_ms)."""
    return log.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("joined", "started", "finished", "cancelled")], F.count("wait_ms").alias("waits"), F.round(F.coalesce(F.sum("wait_ms"), F.lit(0.0)), 3).alias("wait_total"), F.max("wait_ms").alias("wait_max"))


def progress_state(events: DataFrame, phases: list[str]) -> DataFrame:
    """How far each run (key, phase, ord) has come, and whether it has ended."""
    rank = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    g = events.groupBy("key").agg(F.max_by("phase", F.struct(rank, "ord")).alias("phase"), F.count(F.lit(1)).alias("events"))
    return g.withColumn("ended", F.col("phase").isin(phases[-2:]))


def catalogue_state(fetched: Column, tried: Column, complete: Column, now: Column, ttl: int = 3600, retry: int = 60) -> Column:
    """missing, fresh, stale (fetch again) or waiting (tried a moment ago); partial while some pages failed."""
    age, since = F.unix_seconds(now) - F.unix_seconds(fetched), F.unix_seconds(now) - F.unix_seconds(tried)
    return F.when(fetched.isNull() & ~F.coalesce(since < retry, F.lit(False)), "missing").when(fetched.isNull(), "waiting").when(~complete, F.when(since < retry, "partial").otherwise("stale")).when(age < ttl, "fresh").when(since < retry, "waiting").otherwise("stale")


# ── tickets and queues: state machines by key, in arrival order ──

TICKET = "ticket string, state string, changes int, refused int"


def tickets(commands: DataFrame, ttl: int = 900) -> DataFrame:
    """The state of each ticket after its commands (ticket, ord, at, command): create, claim, ready, error, retry. A claim is
    given once; anything after the time to live finds the ticket gone."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, born, changes, refused = None, 0.0, 0, 0
        moves = {("create", None): "pending", ("claim", "pending"): "claimed", ("ready", "claimed"): "ready", ("error", "claimed"): "error", ("retry", "error"): "pending"}
        for at, command in rows.sort_values("ord")[["at", "command"]].itertuples(index=False):
            if state is not None and at - born > ttl:
                state = None
            to = moves.get((command, state))
            if to is None:
                refused += 1
                continue
            born = at if command == "create" else born
            state, changes = to, changes + 1
        return pd.DataFrame([[key[0], state or "gone", changes, refused]], columns=["ticket", "state", "changes", "refused"])

    return commands.groupBy("ticket").applyInPandas(fold, TICKET)


JOB = "queue string, job string, started double, ended double, outcome string, users int"


def queue_runs(requests: DataFrame, slots: int = 4) -> DataFrame:
    """What a queue with `slots` makes of requests (queue, ord, at, job, work, speculative, leave): requests for a job that is
    waiting or running join it; a foreground one promotes it; foreground jobs go first come first served, speculative ones
    only while a slot stays free; a waiting job goes when its last user leaves. Each queue is simulated by itself."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        waiting: dict[str, list] = {}
        running: list[list] = []
        out, clock = [], 0.0
        arrivals = sorted(rows[["at", "ord", "job", "work", "speculative", "leave"]].itertuples(index=False))
        i = 0
        while i < len(arrivals) or waiting or running:
            times = [arrivals[i].at] if i < len(arrivals) else []
            times += [r[1] for r in running] + [u for w in waiting.values() for u in w[4] if u > clock]
            if not times:
                break
            clock = min(times)
            for r in [r for r in running if r[1] <= clock]:
                running.remove(r)
                out.append([key[0], r[0], r[2], r[1], "done", r[3]])
            while i < len(arrivals) and arrivals[i].at <= clock:
                a = arrivals[i]
                i += 1
                if (r := next((r for r in running if r[0] == a.job), None)) is not None:
                    r[3] += 1
                elif a.job in waiting:
                    w = waiting[a.job]
                    w[1] = w[1] and a.speculative
                    w[4].append(a.leave)
                else:
                    waiting[a.job] = [a.ord, a.speculative, a.work, a.at, [a.leave]]
            for job in [j for j, w in waiting.items() if all(u <= clock for u in w[4])]:
                w = waiting.pop(job)
                out.append([key[0], job, None, clock, "cancelled", len(w[4])])
            while waiting and len(running) < slots:
                job = min(waiting, key=lambda j: (waiting[j][1], waiting[j][0]))
                if waiting[job][1] and len(running) >= slots - 1:
                    break
                w = waiting.pop(job)
                running.append([job, clock + w[2], clock, len(w[4])])
        return pd.DataFrame(out, columns=["queue", "job", "started", "ended", "outcome", "users"])

    return requests.groupBy("queue").applyInPandas(run, JOB)


# ── streams ──


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if not name.endswith(".parquet") else name).option("maxFilesPerTrigger", 4).parquet(folder if name.endswith(".parquet") else path)


def stream_leases(events: DataFrame, seconds: int = 30, late: str = "1 hour") -> DataFrame:
    """leases() over a stream (key, ts): a lease comes out once the watermark has passed its end."""
    return leases(events.withWatermark("ts", late), seconds)


def run_to_end(stream: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    """Everything a stream has now, through a checkpointed file sink; the folder is the shared one where there is one."""
    path = path or fresh_dir(spark, "stream")
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
