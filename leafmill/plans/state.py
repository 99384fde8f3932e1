"""Queries over keyed state."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.plans.base import frame, query, values
from leafmill.sources import adapters as src
from leafmill.sources import store
from leafmill.sources.shared import fresh_dir, lots_of
from leafmill.streaming import expiring as x
from leafmill.streaming import state as s


def _events(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")


_RATE = """with recursive e as (select user_id as key, event_id as id, ts, row_number() over (partition by user_id order by ts, event_id) as ord from events),
f as (select key, id, ts, ord, ts as opened, 1 as n from e where ord = 1 union all select e.key, e.id, e.ts, e.ord, case when e.ts >= f.opened + interval 86400 second then e.ts else f.opened end, case when e.ts >= f.opened + interval 86400 second then 1 else f.n + 1 end from f join e on e.key = f.key and e.ord = f.ord + 1)
select key, id, n <= 2 as allowed, greatest(0, 2 - n) as remaining from f"""


@query(_RATE)
def rate_limit_fold(spark, sf_dir):
    return s.rate_limited(_events(spark, sf_dir), 2, 86_400)


@query(_RATE)
def stream_rate_limit(spark, sf_dir):
    """The same from a stream in eight batches that keeps open windows alone between them."""
    rows = _events(spark, sf_dir).select("key", "ts", "id")
    # so many clients' windows to a bucket, whatever the table's size
    buckets = max(1024, 64 * lots_of(rows))
    return s.run_to_end(x.stream_rate_limit(x.segmented(rows, "ts", 8), 2, 86_400, buckets=buckets), spark)


_DESK = """with recursive e as (select user_id as owner, event_id as ord, epoch(ts)::bigint as sec, row_number() over (partition by user_id order by epoch(ts)::bigint, event_id) as k, event_id % 8 as c from events),
r as (select owner, ord, sec, k, case when c < 5 then 'create' when c = 5 then 'claim' when c = 6 and ord % 3 > 0 then 'ready' when c = 6 then 'error' else 'read' end as command, 't' || case when c < 5 then k else k - 1 - ord // 8 % 4 end as ticket from e),
f as (
  select owner, 0::bigint as k, null::bigint as ord, null::varchar as ticket, null::varchar as outcome, []::struct(ticket varchar, status varchar, born bigint)[] as held from (select distinct owner from r)
  union all
  select owner, k, ord, ticket, case when command = 'create' then 'pending' when command = 'read' then coalesce(status, 'expired') when status is null or command = 'claim' and status <> 'pending' then 'refused' when command = 'claim' then 'claimed' when command = 'ready' then 'ready' else 'pending' end,
    case when command = 'create' then list_append(swept, {'ticket': ticket, 'status': 'pending', 'born': sec}) when command = 'read' or status is null or command = 'claim' and status <> 'pending' then swept
      else list_transform(swept, lambda x: case when x.ticket = ticket then {'ticket': x.ticket, 'status': case command when 'claim' then 'claimed' when 'ready' then 'ready' else 'pending' end, 'born': x.born} else x end) end
  from (select *, list_filter(swept, lambda x: x.ticket = ticket)[1].status as status from (
    select r.*, list_filter(f.held, lambda x: x.born + 2160000 > r.sec) as alive, case when command in ('create', 'claim', 'read') then list_slice(alive, -32, -1) else alive end as swept from f join r on r.owner = f.owner and r.k = f.k + 1)))
select owner, ord, ticket, outcome, len(held) as live from f where k > 0"""


def _second():
    """The nearest whole second of an event's time, of two the even one."""
    return F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")


def _commands(spark, sf_dir):
    """A desk for each user; tickets are asked for by their place among the user's events."""
    c, k = F.col("event_id") % 8, F.row_number().over(Window.partitionBy("user_id").orderBy(_second(), "event_id"))
    command = F.when(c < 5, "create").when(c == 5, "claim").when((c == 6) & (F.col("event_id") % 3 > 0), "ready").when(c == 6, "error").otherwise("read")
    e = src.table(spark, sf_dir, "events").withColumn("k", k)
    place = F.when(c < 5, F.col("k")).otherwise(F.col("k") - 1 - F.floor(F.col("event_id") / 8) % 4)
    return e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("ord"), F.timestamp_seconds(_second()).alias("ts"), _second().alias("at"), command.alias("command"), F.concat(F.lit("t"), place.cast("string")).alias("ticket"))


@query(_DESK)
def ticket_desk(spark, sf_dir):
    """Tickets that are claimed once, 32 at a desk, gone after 25 days."""
    return x.desk(_commands(spark, sf_dir), ttl=25 * 86_400)


@query(_DESK)
def stream_ticket_desk(spark, sf_dir):
    """The same from a stream in eight batches, with timers that clear tickets that are over."""
    rows = _commands(spark, sf_dir).drop("at")
    # so many desks to a bucket, whatever the table's size
    buckets = max(1024, 64 * lots_of(rows))
    return s.run_to_end(x.stream_desk(x.segmented(rows, "ts", 8), ttl=25 * 86_400, buckets=buckets), spark)


_LEASE = """with e as (select user_id as key, ts, lag(ts) over (partition by user_id order by ts) as prev from events), g as (select key, ts, sum(case when prev is null or ts >= prev + interval 7200 second then 1 else 0 end) over (partition by key order by ts) as g from e)
select key, min(ts) as start, max(ts) + interval 7200 second as until, count(*) as beats from g group by key, g"""


@query(_LEASE)
def lease_sessions(spark, sf_dir):
    return s.leases(_events(spark, sf_dir), 7200)


@query("""with e as (select user_id as key, ts, lag(ts) over (partition by user_id order by ts) as prev from events), g as (select key, ts, sum(case when prev is null or ts >= prev + interval 7200 second then 1 else 0 end) over (partition by key order by ts) as g from e)
select key, min(ts) as start, max(ts) + interval 7200 second as until, count(*) as beats from g group by key, g having max(ts) + interval 7200 second <= (select max(ts) - interval 1 hour from events)""")
def stream_lease_sessions(spark, sf_dir):
    """Leases out of a stream; those that the watermark hasn't passed yet don't come out."""
    events = s.stream_of(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return s.run_to_end(s.stream_leases(events, 7200), spark)


@query("""with e as (select user_id as key, event_id as ord, (event_id * 13) % 101 + event_id // 50 as generation from events) select key, ord, generation from (select *, max(generation) over (partition by key order by ord rows between unbounded preceding and 1 preceding) as m from e) where m is null or generation >= m""")
def generation_guard(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), ((F.col("event_id") * 13) % 101 + F.floor(F.col("event_id") / 50)).alias("generation"))
    return s.guarded_by_generation(e)


@query("""select event_id as id, user_id as key, event_id % 3 as epoch from events where event_id % 3 = case when user_id % 4 = 0 then 0 else user_id % 3 end""")
def late_writes(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), (F.col("event_id") % 3).alias("epoch"))
    epochs = e.where("key % 4 <> 0").select("key", (F.col("key") % 3).alias("epoch")).distinct()
    return s.committed_in_time(e, epochs).select("id", "key", "epoch")


@query("""with l as (select user_id as key, event_id as id, event_type as kind, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) select key, id, kind, ts from l where r = 1 and ts >= timestamp '2024-01-30 00:00:00' - interval 172800 second""")
def latest_event(spark, sf_dir):
    return s.latest(_events(spark, sf_dir), F.lit("2024-01-30 00:00:00").cast("timestamp"), 86_400 * 2)


def _drained(stream, take, path, replayed=1):
    """Runs a stream into a sink; one of its batches is handed over twice, as after a failure."""

    def sink(rows, number):
        take(rows, number)
        if number == replayed:
            take(rows, number)

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


@query("""with l as (select user_id as key, event_id as ord, event_type as kind, ts, row_number() over (partition by user_id order by event_id desc) as r from events) select key, ord, kind, ts from l where r = 1 and ts >= timestamp '2024-01-30 00:00:00' - interval 172800 second""")
def stream_latest_event(spark, sf_dir):
    """The latest event of each key as a stream has left it in a table, as far as it would be replayed; a batch came twice."""
    path = fresh_dir(spark, "latest")
    tables = store.Store(spark, f"{path}/store")
    events = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    _drained(x.segmented(events, "ts", 5), store.each_batch_once(tables, "events", store.keep_latest(tables, "latest", ["key"], "ord")), path)
    return store.replay(tables, "latest", "key", F.lit("2024-01-30 00:00:00").cast("timestamp"), 86_400 * 2)


@query("""with recursive u as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) as ord, (event_id * 7) % 5 as expected, event_type as value from events),
f as (select key, 0::bigint as ord, 0::bigint as version, null::varchar as value, 0 as status from (select distinct key from u)
  union all select u.key, u.ord, case when u.expected = f.version then f.version + 1 else f.version end, case when u.expected = f.version then u.value else f.value end, case when u.expected = f.version then 200 else 409 end from f join u on u.key = f.key and u.ord = f.ord + 1)
select key, ord, status, version, value from f where ord > 0""")
def stream_conflicts(spark, sf_dir):
    """Saved places by a stream of compare-and-set writes: a stale version is answered with 409 and what is there; a batch came twice."""
    path = fresh_dir(spark, "marks")
    tables = store.Store(spark, f"{path}/store")
    e = src.table(spark, sf_dir, "events").withColumn("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    updates = e.select(F.col("user_id").alias("key"), F.col("ord").cast("long").alias("ord"), ((F.col("event_id") * 7) % 5).alias("expected"), F.col("event_type").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    _drained(x.segmented(updates, "ts", 5), store.each_batch_once(tables, "marks", store.compare_and_set_batch(tables, "marks", "verdicts")), path)
    return tables.read("verdicts")


@query("""with n as (select user_id as key, ts, event_id as id, lead(ts) over (partition by user_id order by ts, event_id) as n from events) select key, id from n where n is null or epoch_us(n) - epoch_us(ts) > 3600000000""")
def debounce(spark, sf_dir):
    return s.debounced(_events(spark, sf_dir), 3_600_000).select("key", "id")


@query("""with n as (select user_id as key, ts, lag(ts) over (partition by user_id order by ts, event_id) as since from events) select key, since, ts, (epoch_us(ts) - epoch_us(since)) / 1e6 as gap from n where (epoch_us(ts) - epoch_us(since)) / 1e6 > 86400""")
def stall_gaps(spark, sf_dir):
    return s.stalls(_events(spark, sf_dir), 86_400)


@query("""select user_id as key, cast(floor(epoch(ts) / 3600) as bigint) as bucket, arg_max(value, (ts, event_id)) as value from events group by all""")
def coalesced_bookmarks(spark, sf_dir):
    return s.coalesced(_events(spark, sf_dir), 3600)


@query("""with r as (select user_id as key, value as ms, row_number() over (partition by user_id order by event_id desc) as r from events), t as (select key, list_sort(list(ms) filter (where r <= 50)) as t, count(*) as count, floor(avg(ms) + 0.5)::bigint as mean, floor(max(ms) + 0.5)::bigint as max from r group by key)
select key, count, mean, max, floor(t[floor(len(t) / 2)::int + 1] + 0.5)::bigint as p50, floor(t[least(len(t) - 1, floor(len(t) * 0.95)::int) + 1] + 0.5)::bigint as p95 from t""")
def timing_summary(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), F.col("value").alias("ms"))
    return s.timing(e)


@query("""with l as (select ['joined', 'started', 'finished', 'cancelled'][1 + event_id % 4] as kind, case when event_id % 4 = 1 then event_id % 977 / 10.0::double end as wait_ms from events)
select count(*) filter (where kind = 'joined') as joined, count(*) filter (where kind = 'started') as started, count(*) filter (where kind = 'finished') as finished, count(*) filter (where kind = 'cancelled') as cancelled, count(wait_ms) as waits, round(sum(wait_ms), 3) as wait_total, max(wait_ms) as wait_max from l""")
def queue_stats(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("joined", "started", "finished", "cancelled")))
    e = src.table(spark, sf_dir, "events")
    return s.queue_stats(e.select(kinds[(F.col("event_id") % 4).cast("int")].alias("kind"), F.when(F.col("event_id") % 4 == 1, F.col("event_id") % 977 / 10.0).alias("wait_ms")))


PHASES = ["received", "reading", "read", "looked", "done", "failed"]


@query(f"""with e as (select user_id as key, event_id as ord, {PHASES!r}[1 + (event_id * 7) % case when user_id % 3 = 0 then 6 else 4 end] as phase from events), r as (select *, list_position({PHASES!r}, phase) as p from e)
select key, arg_max(phase, (p, ord)) as phase, count(*) as events, arg_max(phase, (p, ord)) in ('done', 'failed') as ended from r group by key""")
def staged_progress(spark, sf_dir):
    names = F.array(*map(F.lit, PHASES))
    e = src.table(spark, sf_dir, "events")
    at = (F.col("event_id") * 7) % F.when(F.col("user_id") % 3 == 0, 6).otherwise(4)
    return s.progress_state(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), names[at.cast("int")].alias("phase")), PHASES)


_CATALOGUES = [(1, None, None, True), (2, None, 30, True), (3, 100, 100, True), (4, 4000, 4000, True), (5, 4000, 10, True), (6, 100, 10, False), (7, 100, 100, False)]


@query(f"""with {values("c", "id long, age long, since long, complete boolean", _CATALOGUES)} select id, case when age is null and not coalesce(since < 60, false) then 'missing' when age is null then 'waiting' when not complete then case when since < 60 then 'partial' else 'stale' end when age < 3600 then 'fresh' when since < 60 then 'waiting' else 'stale' end as state from c""")
def catalogue_state(spark, sf_dir):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    ago = lambda c: F.timestamp_add("SECOND", -F.col(c), now)
    c = frame(spark, "id long, age long, since long, complete boolean", _CATALOGUES)
    return c.select("id", s.catalogue_state(ago("age"), ago("since"), F.col("complete"), now).alias("state"))


@query("""with recursive e as (select 't' || user_id as ticket, epoch(ts)::bigint::double as at, ['create', 'claim', 'ready', 'error', 'retry'][1 + event_id % 5] as command, row_number() over (partition by user_id order by event_id) as k from events),
f(ticket, k, state, born, changes, refused) as (select distinct ticket, 0::bigint, '', 0.0::double, 0::bigint, 0::bigint from e union all
  select n.ticket, n.k, if(n.next = '', n.state, n.next), if(n.next = 'pending' and n.command = 'create', n.at, n.born), n.changes + (n.next <> '')::int, n.refused + (n.next = '')::int from (
    select o.*, case when o.command = 'create' and o.state = '' then 'pending' when o.command = 'claim' and o.state = 'pending' then 'claimed' when o.command = 'ready' and o.state = 'claimed' then 'ready'
      when o.command = 'error' and o.state = 'claimed' then 'error' when o.command = 'retry' and o.state = 'error' then 'pending' else '' end as next
    from (select e.ticket, e.k, e.at, e.command, f.born, f.changes, f.refused, if(f.state <> '' and e.at - f.born > 864000, '', f.state) as state from f join e on e.ticket = f.ticket and e.k = f.k + 1) o) n)
select ticket, if(arg_max(state, k) = '', 'gone', arg_max(state, k)) as state, max(changes) as changes, max(refused) as refused from f group by ticket""")
def ticket_lifecycle(spark, sf_dir):
    """A ticket for each user, its commands the user's events in order."""
    names = F.array(*map(F.lit, ("create", "claim", "ready", "error", "retry")))
    e = src.table(spark, sf_dir, "events")
    return s.tickets(e.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("ticket"), F.col("event_id").alias("ord"), _second().cast("double").alias("at"), names[(F.col("event_id") % 5).cast("int")].alias("command")), ttl=10 * 86_400)


@query()
def job_queue(spark, sf_dir):
    """A queue for each kind of event: what started when, what joined, what was cancelled."""
    e = src.table(spark, sf_dir, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return s.queue_runs(e.select(F.col("event_type").alias("queue"), F.col("event_id").alias("ord"), at.alias("at"), F.concat(F.lit("j"), (F.col("user_id") % 20).cast("string")).alias("job"), (F.lit(300.0) + F.col("event_id") % 1200).alias("work"), (F.col("event_id") % 3 == 0).alias("speculative"), (at + 600 + F.col("event_id") % 900).alias("leave")))


_HAPPENED = "case when event_id % 397 = 0 then 'reset' when event_id % 17 = 0 then 'drop' when event_id % 11 = 0 then 'invalidate' when event_id % 13 = 0 then 'forget' else 'none' end"


@query(f"""with h as (select event_id as ord, {_HAPPENED} as kind, user_id as session, event_id % 40 as article_id from events), s as (select user_id as session, (user_id * 3) % 40 as article_id, max(event_id) as ord from events group by user_id)
select session, article_id from s where ord > coalesce(greatest((select max(ord) from h where kind = 'drop' and h.session = s.session), (select max(ord) from h where kind in ('invalidate', 'forget') and h.article_id = s.article_id), (select max(ord) from h where kind = 'reset')), -1)""")
def kept_sessions(spark, sf_dir):
    """Demand sessions that stand after drops, changed articles and resets."""
    e = src.table(spark, sf_dir, "events")
    happened = e.selectExpr("event_id as ord", f"{_HAPPENED} as kind", "user_id as session", "event_id % 40 as article_id")
    sessions = e.groupBy(F.col("user_id").alias("session")).agg(F.max("event_id").alias("ord")).withColumn("article_id", F.col("session") * 3 % 40)
    return s.kept_sessions(sessions, happened).select("session", "article_id")


@query(f"""with h as (select event_id as ord, {_HAPPENED} as kind, event_id % 40 as article_id from events), a as (select article_id, count(*) as n, min(ord) as first from h where kind in ('invalidate', 'forget') group by article_id)
select article_id, n + (select count(*) from h where kind = 'reset' and ord > a.first) as epoch from a""")
def article_epochs(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").selectExpr("event_id as ord", f"{_HAPPENED} as kind", "event_id % 40 as article_id")
    return s.article_epochs(e)


@query("select user_id as key, max(event_id) as used, row_number() over (order by max(event_id)) - greatest(0, (select count(distinct user_id) from events) - 24) as place from events group by user_id qualify row_number() over (order by max(event_id) desc) <= 24")
def script_memory(spark, sf_dir):
    """The 24 scripts that a bounded memory holds after all accesses."""
    return s.bounded_lru(src.table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("key")))


@query("""with a as (select user_id as call, row_number() over (partition by user_id order by event_id) as n, event_id % 50 + 0.5::double as took, event_id % 7 + 0.0::double as wait, event_id % 3 = 0 as ok, event_id % 5 > 0 as retryable from events),
w as (select *, coalesce(sum(least(took, 30.0::double) + wait) over p, 0) as s, coalesce(bool_or((ok and took <= 30) or not retryable) over p, false) as o from a window p as (partition by call order by n rows between unbounded preceding and 1 preceding)),
m as (select *, least(30.0::double, 60 - s) as c from w where not o and n <= 3 and s < 60) select call, n, s as started, least(took, c) as ran, case when took > c then 'timeout' when ok then 'ok' else 'failed' end as outcome from m""")
def provider_attempts(spark, sf_dir):
    """Attempts of calls under a shared deadline of a minute and half a minute each."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("call"), n.alias("n"), (F.col("event_id") % 50 + 0.5).cast("double").alias("took"), (F.col("event_id") % 7).cast("double").alias("wait"), (F.col("event_id") % 3 == 0).alias("ok"), (F.col("event_id") % 5 > 0).alias("retryable"))
    return s.attempts_within(e, 60.0, 30.0)
