"""Queries that show what a write makes of the tables."""

from pyspark.sql import functions as F

from leafmill.operators import writes as w
from leafmill.plans.base import frame, query, values
from leafmill.sources import adapters as src

WITH = f"with {src.ARTICLES_SQL}, {src.COLLECTIONS_SQL}, {src.MEMBERS_SQL}"


@query(f"{WITH}, t as (select max(id) as top from articles) select id, title from articles union all select top + row_number() over (order by page_id), url from pages, t")
def insert_articles(spark, sf_dir):
    new = src.table(spark, sf_dir, "pages").select(F.col("url").alias("title"), F.col("page_id").alias("arrival"))
    return w.inserted(src.articles(spark, sf_dir).select("id", "title"), new)


@query(f"{WITH} select id, case when id % 4 = 0 then 'new ' || id else title end as title, favorite or id % 6 = 0 as favorite, site_name from articles")
def patch_articles(spark, sf_dir):
    a = src.articles(spark, sf_dir).select("id", "title", "favorite", "site_name")
    ch = a.select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("new "), F.col("id").cast("string"))).alias("title"), F.when(F.col("id") % 6 == 0, F.lit(True)).alias("favorite"), F.lit("never").alias("site_name")).where("title is not null or favorite is not null")
    return w.patched(a, ch)


@query(f"{WITH} select id, url, case when id % 5 = 0 then 'again ' || id else title end as title, case when id % 5 = 0 then 1 else word_count end as word_count, favorite, progress from articles")
def refetch_articles(spark, sf_dir):
    a = src.articles(spark, sf_dir).select("id", "url", "title", "word_count", "favorite", "progress")
    content = a.where("id % 5 = 0").select("url", F.lit(0).cast("long").alias("id"), F.concat(F.lit("again "), F.col("id").cast("string")).alias("title"), F.lit(1).cast("long").alias("word_count"), F.lit(False).alias("favorite"), F.lit(0.0).alias("progress"))
    return w.replaced(a, content, "url", keep=["id", "favorite", "progress"])


@query(f"{WITH}, n as (select 'https://src' || (doc_id % 25) || '.example.org/en/' || doc_id as url from documents) select n.url, a.id as old_id, case when a.id is null then 'insert' else 'replace' end as action from n left join articles a on a.url = n.url")
def save_decision(spark, sf_dir):
    new = src.table(spark, sf_dir, "documents").select(F.concat(F.lit("https://src"), (F.col("doc_id") % 25).cast("string"), F.lit(".example.org/en/"), F.col("doc_id").cast("string")).alias("url"))
    return w.saved(src.articles(spark, sf_dir).select("id", "url"), new)


@query(f"{WITH}, g as (select id from articles where id % 8 = 3) select collection_id, count(*) as members, (select count(*) from articles where id not in (select id from g)) as articles from article_collections where article_id not in (select id from g) group by collection_id")
def delete_cascade(spark, sf_dir):
    a = src.articles(spark, sf_dir).select("id")
    gone = a.where("id % 8 = 3")
    left = w.deleted(a, gone).agg(F.count(F.lit(1)).alias("articles"))
    return w.cascaded(src.article_collections(spark, sf_dir), gone, "article_id").groupBy("collection_id").agg(F.count(F.lit(1)).alias("members")).crossJoin(F.broadcast(left))


@query("""with t as (select distinct user_id as key, 'old' as value from events where user_id % 3 = 0), n as (select user_id as key, event_type as value, row_number() over (partition by user_id order by event_id) as r from events)
select key, value from t union all select key, value from n where r = 1 and key not in (select key from t)""")
def insert_or_ignore(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    old = e.where("user_id % 3 = 0").select(F.col("user_id").alias("key")).distinct().withColumn("value", F.lit("old"))
    return w.insert_or_ignore(old, e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "event_id"), ["key"], "event_id")


@query("""with t as (select distinct user_id as key, 'old' as value from events), n as (select user_id as key, event_type as value, row_number() over (partition by user_id order by event_id desc) as r from events where user_id % 3 = 0)
select key, value from n where r = 1 union all select key, value from t where key not in (select key from n)""")
def upsert_latest(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    old = e.select(F.col("user_id").alias("key")).distinct().withColumn("value", F.lit("old"))
    return w.upserted(old, e.where("user_id % 3 = 0").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "event_id"), ["key"], "event_id")


@query("""with recursive u as (select user_id as key, row_number() over (partition by user_id order by event_id) as ord, (event_id * 7) % 5 as expected, event_type as value from events),
f as (select key, 0::bigint as ord, 0::bigint as version, null::varchar as value, false as ok from (select distinct key from u)
  union all select u.key, u.ord, case when u.expected = f.version then f.version + 1 else f.version end, case when u.expected = f.version then u.value else f.value end, u.expected = f.version from f join u on u.key = f.key and u.ord = f.ord + 1)
select key, ord, ok, version, value from f where ord > 0""")
def cas_fold(spark, sf_dir):
    from pyspark.sql import Window

    e = src.table(spark, sf_dir, "events").withColumn("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return w.compare_and_set(e.select(F.col("user_id").alias("key"), "ord", ((F.col("event_id") * 7) % 5).alias("expected"), F.col("event_type").alias("value")))


@query(f"{WITH}, v as (select doc_id * 2 as article_id, case when doc_id % 3 = 0 then 'stale' else 'r' || doc_id * 2 end as content_revision from documents) select article_id, content_revision, case when a.id is null then 'not_found' when 'r' || a.id <> content_revision then 'content_changed' else 'saved' end as outcome from v left join articles a on a.id = article_id")
def guarded_insert(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("article_id"), F.when(F.col("doc_id") % 3 == 0, F.lit("stale")).otherwise(F.concat(F.lit("r"), (F.col("doc_id") * 2).cast("string"))).alias("content_revision"))
    now = src.articles(spark, sf_dir).select("id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("content_revision"))
    return w.guarded(d, now)


@query(f"with {src.CACHE_SQL}, l as (select o_orderkey as key, max(o_orderdate + to_days(30)) as ts from orders where o_orderkey % 3 = 0 group by 1) select key, greatest(used, coalesce(ts, used)) as used from audio_cache left join l using (key)")
def touch_used(spark, sf_dir):
    a = src.audio_cache(spark, sf_dir).select("key", "used")
    return w.touched(a, a.where("key % 3 = 0").select("key", F.timestamp_add("DAY", F.lit(30), F.col("used")).alias("ts")), ["key"])


_NEW = [(1, "  Longreads "), (2, "longREADS"), (3, " "), (4, "List 2"), (5, "Later"), (6, "y" * 50)]


@query(f"""with {src.COLLECTIONS_SQL}, {values("n", "arrival long, name string", _NEW)}, c as (select arrival, substr(trim(name), 1, 40) as name from n), j as (select *, case when name = '' then 'empty' when lower(name) in (select lower(name) from collections) or row_number() over (partition by lower(name) order by arrival) > 1 then 'taken' else 'ok' end as verdict from c)
select arrival, name, verdict, case when verdict = 'ok' then 5 + count(*) filter (where verdict = 'ok') over (order by arrival) end as position from j""")
def list_create(spark, sf_dir):
    return w.list_changes(src.collections(spark), frame(spark, "arrival long, name string", _NEW))


_BODIES = [(1, "<p>a</p>", '<p data-speech="exclude">a</p>', "partial", "stub"), (2, "<p>a</p>", "<p>b</p>", "partial", "full"), (3, "", "", "full", None), (4, "<p>a</p>", "<p>a </p>", None, "full")]


@query(f"""with {values("b", "id long, old string, new string, quality string, verdict string", _BODIES)} select id, regexp_replace(old, ' data-speech="[^"]*"', '', 'g') <> regexp_replace(new, ' data-speech="[^"]*"', '', 'g') as edited, case when quality = 'partial' and verdict <> 'stub' then quality else coalesce(verdict, quality) end as quality from b""")
def edit_and_enrich(spark, sf_dir):
    b = frame(spark, "id long, old string, new string, quality string, verdict string", _BODIES)
    return b.select("id", w.edited(F.col("old"), F.col("new")).alias("edited"), w.enriched_quality(F.col("quality"), F.col("verdict")).alias("quality"))


@query(f"{WITH} select id from articles where not favorite order by saved_at, id limit 1")
def cap_victim(spark, sf_dir):
    return w.victim(src.articles(spark, sf_dir).select("id", "favorite", "saved_at"), 15).select("id")


@query(f"""{WITH}, m as (select a.id, list_sort(list(collection_id) filter (where collection_id is not null)) as l from articles a left join article_collections on article_id = a.id group by a.id)
select id, coalesce(array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(l, []), lambda x: x <> 3), case when id = 4 then [9] else [] end))), ','), '') as lists from m""")
def membership_arrays(spark, sf_dir):
    from leafmill.operators import library as lib

    a = lib.with_collections(src.articles(spark, sf_dir).select("id"), src.article_collections(spark, sf_dir))
    a = w.with_member(w.without_list(a, 3), 4, 9, True)
    return a.select("id", F.array_join(F.transform(F.sort_array("collections"), lambda x: x.cast("string")), ",").alias("lists"))


@query(f"""{WITH}, s as (select id, saved_at, length(text_content) + 200 as size, length(text_content) as body from articles), t as (select sum(size) as total from s)
select id, total - coalesce(sum(body) over (order by saved_at, id rows between unbounded preceding and 1 preceding), 0) > 1000000 as blank from s, t""")
def local_quota(spark, sf_dir):
    n = F.length("text_content")
    return w.persisted(src.articles(spark, sf_dir).select("id", "saved_at", (n + 200).alias("size"), n.alias("body")), 1_000_000).select("id", "blank")


@query(f"{WITH}, {src.CACHE_SQL} select a.id, count(c.key) as passages, coalesce(sum(c.bytes), 0) as bytes, 2 as version from articles a left join audio_cache c on c.article_id = a.id and c.key % 2 = 0 where a.id % 10 <> 0 group by a.id")
def purge_narration(spark, sf_dir):
    """Articles with what is left of their derived data once every tenth one's, and all odd passages, are purged."""
    a, c = src.articles(spark, sf_dir).select("id"), src.audio_cache(spark, sf_dir)
    kept = w.cascaded(w.deleted(c, c.where("key % 2 = 1"), "key"), a.where("id % 10 = 0"), "article_id")
    j = w.deleted(a, a.where("id % 10 = 0")).join(kept, F.col("id") == F.col("article_id"), "left")
    return j.groupBy("id").agg(F.count("key").alias("passages"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("version", F.lit(2))


_OLD = """o as (select script, seq, case when seq = 0 then 'intro' when seq % 5 = 4 then 'caption' when seq % 3 = 0 then 'heading' else 'text' end as kind, cast(duration * 15.5 as int) as chars, 200 as pause, case when seq % 2 = 0 then duration end as measured from segments),
e as (select *, sum(coalesce(measured, chars / case kind when 'intro' then 9.0 when 'heading' then 12.0 else 15.5 end::double + pause / 1000.0::double)) over (partition by script order by seq) as stop from o where kind <> 'caption')"""


@query(f"""with {src.SEGMENTS_SQL}, {_OLD}, g as (select script, script % 90 + 0.01::double as seconds from (select distinct script from segments) where script % 4 > 0),
f as (select g.script, min(e.seq) as seq from g join e on e.script = g.script and g.seconds < e.stop group by g.script)
select 'bookmark' as kind, g.script as id, f.seq, f.seq is null as completed from g left join f using (script)
union all select 'bookmark', script, 0, false from (select distinct script from segments) where script % 4 = 0
union all select 'variant', script, null, null from (select distinct script from segments) where script % 5 > 0
union all select 'audio', script, seq, null from segments where script % 5 > 0""")
def legacy_conversion(spark, sf_dir):
    """Old progress in seconds becomes bookmarks, variants of changed articles are refused and their audio goes, and the old
    table is emptied: one commit of four tables. Asked for again, it finds itself done."""
    from leafmill.operators import timeline as t
    from leafmill.sources.shared import fresh_dir
    from leafmill.sources.store import Store

    tables, s = Store(spark, fresh_dir(spark, "conversion")), src.segments(spark, sf_dir)
    scripts = s.select("script").distinct()
    tables.commit(tables.snapshot(), {
        "progress": scripts.select("script", (F.col("script") % 90 + 0.01).cast("double").alias("seconds")),
        "bookmarks": scripts.where("script % 4 = 0").select("script", F.lit(0).cast("long").alias("seq"), F.lit(False).alias("completed")),
        "audio": s.select("script", F.col("seq").cast("long").alias("seq")),
        "variants": spark.createDataFrame([], "script long"),
    })
    kind = F.when(F.col("seq") == 0, "intro").when(F.col("seq") % 5 == 4, "caption").when(F.col("seq") % 3 == 0, "heading").otherwise("text")
    old = s.select("script", "seq", kind.alias("kind"), F.floor(F.col("duration") * 15.5 + 0.5).alias("chars"), F.lit(200).alias("pause"), F.when(F.col("seq") % 2 == 0, F.col("duration")).alias("measured"))
    offered = scripts.select(F.col("script").alias("article_id"), F.lit("r").alias("content_revision"))
    present = scripts.select(F.col("script").alias("id"), F.when(F.col("script") % 5 == 0, "changed").otherwise("r").alias("content_revision"))

    def convert(at):
        if at.batches.get("conversion"):
            return {}
        progress, marks = tables.read("progress", at), tables.read("bookmarks", at)
        found = t.legacy_block(old, progress.join(marks, "script", "left_anti")).select("script", F.col("seq").cast("long").alias("seq"), "completed")
        judged = w.guarded(offered, present)
        stale = judged.where("outcome <> 'saved'").select(F.col("article_id").alias("script"))
        return {
            "appended": {"bookmarks": found, "variants": judged.where("outcome = 'saved'").select(F.col("article_id").alias("script"))},
            "replaced": {"audio": tables.read("audio", at).join(stale, "script", "left_anti"), "progress": progress.limit(0)},
            "batch": ("conversion", 1),
        }

    tables.transact(convert)
    at = tables.transact(convert)
    row = lambda name, seq, done: tables.read(name, at).select(F.lit({"bookmarks": "bookmark", "variants": "variant"}.get(name, name)).alias("kind"), F.col("script").alias("id"), seq.cast("long").alias("seq"), done.cast("boolean").alias("completed"))
    none = F.lit(None)
    left = tables.read("progress", at).select(F.lit("progress").alias("kind"), F.col("script").alias("id"), none.cast("long").alias("seq"), none.cast("boolean").alias("completed"))
    return row("bookmarks", F.col("seq"), F.col("completed")).unionByName(row("variants", none, none)).unionByName(row("audio", F.col("seq"), none)).unionByName(left)
