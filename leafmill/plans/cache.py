"""Queries over caches."""

from pyspark.sql import functions as F

from leafmill.operators import cache as c
from leafmill.plans.base import frame, query, values
from leafmill.sources import adapters as src

WITH = f"with {src.CACHE_SQL}"


@query(f"{WITH} select (select coalesce(sum(bytes), 0) from audio_cache where not protected) + (select coalesce(sum(bytes), 0) from audio_cache where protected) as total, (select coalesce(sum(bytes), 0) from audio_cache where key < 0) as nothing")
def cache_bytes(spark, sf_dir):
    return src.audio_cache(spark, sf_dir).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("key") < 0, F.col("bytes"))), F.lit(0)).alias("nothing"))


@query(f"""{WITH}, n as (select sum(bytes) + 5000000 - 1000000000 as need, sum(bytes) filter (where not protected) as free from audio_cache),
r as (select key, bytes, coalesce(sum(bytes) over (order by used, key rows between unbounded preceding and 1 preceding), 0) as freed from audio_cache where not protected)
select key, bytes, freed from r, n where need > 0 and free >= need and freed < need""")
def lru_evict(spark, sf_dir):
    return c.lru_victims(src.audio_cache(spark, sf_dir), 5_000_000, 1_000_000_000)


_ROOMS = [(1, 5_000_000, 5_000_001), (2, 5_000_000, 1_000_000_000), (3, 600, 500), (4, 100, 10**15), (5, 1_000, 10**9)]


@query(f"""{WITH}, {values("q", "id long, incoming long, ceiling long", _ROOMS)}, n as (select id, incoming, ceiling, (select sum(bytes) from audio_cache) + incoming - ceiling as need, (select coalesce(sum(bytes), 0) from audio_cache where not protected) as free from q),
r as (select key, bytes, coalesce(sum(bytes) over (order by used, key rows between unbounded preceding and 1 preceding), 0) as freed from audio_cache where not protected)
select n.id, count(r.key) as victims, coalesce(sum(r.bytes), 0)::bigint as bytes, any_value(n.incoming <= n.ceiling and n.need <= n.free) as granted from n left join r on n.incoming <= n.ceiling and n.need > 0 and n.free >= n.need and r.freed < n.need group by n.id""")
def lru_evict_refused(spark, sf_dir):
    """Requests for room, some refused: nothing goes where all that may go isn't enough, or the item is too large."""
    cache, out = src.audio_cache(spark, sf_dir), None
    held = cache.agg(F.sum("bytes").alias("total"), F.coalesce(F.sum(F.when(~F.col("protected"), F.col("bytes"))), F.lit(0)).alias("free"))
    for i, incoming, ceiling in _ROOMS:
        gone = c.lru_victims(cache, incoming, ceiling).agg(F.count("key").alias("victims"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        granted = (F.lit(incoming) <= ceiling) & (F.col("total") + incoming - ceiling <= F.col("free"))
        one = gone.crossJoin(held.select(granted.alias("granted"))).withColumn("id", F.lit(i).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{WITH}, o as (select key, bytes, key % 5 = 0 as pinned, article_id = 7 as mine, used from audio_cache where not protected),
r as (select key, bytes, coalesce(sum(bytes) over (order by pinned, mine, used, key rows between unbounded preceding and 1 preceding), 0) as freed from o) select key, bytes, freed from r where freed < 30000000""")
def browser_evict(spark, sf_dir):
    return c.browser_victims(src.audio_cache(spark, sf_dir).withColumn("pinned", F.col("key") % 5 == 0), 7, 30_000_000)


@query(f"""{WITH}, r as (select article_id, key as rev, row_number() over (partition by article_id order by used desc, key) as rank, protected from audio_cache) select article_id, rev, rank, rank <= 3 or protected as kept from r""")
def variant_prune(spark, sf_dir):
    v = src.audio_cache(spark, sf_dir).select("article_id", F.col("key").alias("rev"), "used", "protected")
    return c.kept_variants(v).select("article_id", "rev", "rank", "kept")


@query(f"""{WITH}, v as (select distinct article_id, key % 4 as script_id from audio_cache where key % 3 <> 0), ch as (select distinct article_id, key % 4 as script_id from audio_cache) select article_id, script_id from ch where not exists (select 1 from v where v.article_id = ch.article_id and v.script_id = ch.script_id)""")
def orphan_choices(spark, sf_dir):
    a = src.audio_cache(spark, sf_dir).select("article_id", (F.col("key") % 4).alias("script_id"), "key")
    return c.orphan_choices(a.select("article_id", "script_id").distinct(), a.where("key % 3 <> 0"))


@query(f"""{WITH}, i as (select key from audio_cache where key % 10 <> 1), s as (select key from audio_cache where key % 10 <> 2)
select key, 'forget' as action from i where key not in (select key from s) union all select key, 'delete' from s where key not in (select key from i)""")
def cache_reconcile(spark, sf_dir):
    a = src.audio_cache(spark, sf_dir)
    return c.reconciled(a.where("key % 10 <> 1"), a.where("key % 10 <> 2"))


@query("""with l as (select o_orderkey as seq, o_custkey as article_id, cast(floor(o_totalprice) as bigint) as bytes, o_orderdate as created_at from orders where o_orderkey % 2 = 0),
n as (select c_custkey as article_id, case when c_custkey % 3 = 0 then timestamp '2024-01-01' + to_days(c_custkey::int % 30) end as played_at, case when c_custkey % 3 = 1 then timestamp '2023-01-01' end as made_at from customer where c_custkey % 5 <> 0)
select 'audio' as kind, o_custkey as article_id, 'r' || o_orderkey as rev, o_orderkey as seq, cast(floor(o_totalprice) as bigint) as bytes, o_orderdate as used from orders where o_orderkey % 2 = 1
union all select 'legacy', l.article_id, null, seq, bytes, coalesce(played_at, made_at, created_at) from l left join n using (article_id)""")
def audio_union(spark, sf_dir):
    a = src.audio_cache(spark, sf_dir)
    cust = src.table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0")
    played = F.when(F.col("c_custkey") % 3 == 0, F.timestamp_add("DAY", (F.col("c_custkey") % 30).cast("int"), F.lit("2024-01-01").cast("timestamp")))
    notes = cust.select(F.col("c_custkey").alias("article_id"), played.alias("played_at"), F.when(F.col("c_custkey") % 3 == 1, F.lit("2023-01-01").cast("timestamp")).alias("made_at"))
    now = a.where("key % 2 = 1").select("article_id", F.concat(F.lit("r"), F.col("key").cast("string")).alias("rev"), F.col("key").alias("seq"), "bytes", "used")
    old = a.where("key % 2 = 0").select("article_id", F.col("key").alias("seq"), "bytes", F.col("used").alias("created_at"))
    return c.all_audio(now, old, notes)


@query("select user_id as key, max(ts) as used from events group by user_id order by used desc, key limit 8")
def recent_voices(spark, sf_dir):
    return c.recent(src.jobs(spark, sf_dir).select("key", F.col("ts").alias("used")), 8)


_STATUS = f"""with {src.SEGMENTS_SQL}, w as (select script as variant, seq, duration from segments), s as (select script as variant, seq from segments where (script + seq) % 3 <> 0 or script % 5 = 0)"""


def _wanted(spark, sf_dir):
    w = src.segments(spark, sf_dir).select(F.col("script").alias("variant"), "seq", "duration")
    return w, w.where((F.col("variant") + F.col("seq")) % 3 != 0).union(w.where((F.col("variant") % 5 == 0) & ((F.col("variant") + F.col("seq")) % 3 == 0)))


@query(f"""{_STATUS} select w.variant, count(s.seq) as local, count(*) as total, count(s.seq) = count(*) as ready, cast(floor(coalesce(round(sum(case when s.seq is null then duration end), 2), 0) * 8000 + 0.5) as bigint) as missing_bytes from w left join s on s.variant = w.variant and s.seq = w.seq group by w.variant""")
def download_status(spark, sf_dir):
    return c.status(*_wanted(spark, sf_dir))


@query(f"""{_STATUS}, f as (select variant from w group by variant having round(sum(duration), 2) * 8000 <= 3000000) select variant, seq, duration from w where variant in (select variant from f) and not exists (select 1 from s where s.variant = w.variant and s.seq = w.seq)""")
def download_missing(spark, sf_dir):
    return c.to_download(*_wanted(spark, sf_dir), 3_000_000)


_NAMES = [(n,) for n in ("app:shell-v3", "app:shell-v5", "other:shell-v1", "shell-v2", "shell-v9", "images", "app:audio-v4")]


@query(rf"""with {values("n", "name string", _NAMES)}, v as (select name, regexp_extract(name, '^([a-z-]+):([a-z]+)-v(\d+)$', 1) as scope, coalesce(nullif(regexp_extract(name, '-v(\d+)$', 1), '')::int, 5) as v from n) select name, case when scope <> '' then scope = 'app' and v < 5 else v < 5 end as obsolete from v""")
def obsolete_caches(spark, sf_dir):
    return frame(spark, "name string", _NAMES).select("name", c.obsolete(F.col("name"), "app", 5).alias("obsolete"))


@query("""with w as (select distinct user_id * 10 + hour(ts) as key from events where event_type in (select min(event_type) from events)), r as (select distinct user_id * 10 + hour(ts) as key from events where event_type in (select max(event_type) from events))
select key, 'start' as action from w where key not in (select key from r) union all select key, 'cancel' from r where key not in (select key from w)""")
def window_diff(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").select((F.col("user_id") * 10 + F.hour("ts")).alias("key"), "event_type", F.col("user_id").alias("session"))
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    wanted = e.join(F.broadcast(ends), F.col("event_type") == F.col("lo")).select("session", "key")  # one row
    running = e.join(F.broadcast(ends), F.col("event_type") == F.col("hi")).select("key")
    return c.wanted_not_running(wanted, running)


@query("""with s as (select user_id as session, 'k' || (event_id % 40) as key from events where event_id % 7 = 0), j as (select 'k' || (event_id % 55) as key from events where event_id % 11 = 0) select key from s union select key from j""")
def protected_keys(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    own = e.where("event_id % 7 = 0").select(F.concat(F.lit("k"), (F.col("event_id") % 40).cast("string")).alias("key"))
    return own.union(e.where("event_id % 11 = 0").select(F.concat(F.lit("k"), (F.col("event_id") % 55).cast("string")).alias("key"))).distinct()
