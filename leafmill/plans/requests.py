"""Queries over what comes in with requests and goes out with articles."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators import extract, requests
from leafmill.plans.base import frame, query
from leafmill.sources import adapters as src

_BODIES = [(1, " <p>x</p> ", '{"title": "  A title ", "excerpt": ""}', " v1 ", " Voice\x07 One ", "block", "b1-0", 1.4), (2, "  ", None, None, None, None, None, -0.5), (3, None, "{}", "", "x", "block", "b b", 0.5), (4, "", '{"title": 3, "byline": "%s"}' % ("y" * 500), "a\x00b", None, "beginning", None, None), (5, "x", "{}", "z" * 257, "n", "other", "b", 1.0)]
_COLUMNS = "id long, html string, meta string, vid string, vname string, mode string, block string, progress double"


@query("""select * from (values (1, ' <p>x</p> ', 'A title', null, 'set', 'v1', 'Voice One', 'block', 1.0::double), (2, null, null, null, 'cleared', null, null, 'resume', 0.0), (3, null, null, null, 'refused', null, null, null, 0.5), (4, null, '3', repeat('y', 400), 'refused', null, null, 'beginning', null), (5, 'x', null, null, 'refused', null, null, null, 1.0)) t(id, source, title, byline, given, voice, name, start, progress)""")
def request_fields(spark, sf_dir):
    b = frame(spark, _COLUMNS, _BODIES).withColumn("f", requests.link_fallback(F.col("meta"))).withColumn("v", requests.voice_input(F.col("vid"), F.col("vname")))
    start = requests.start_mode(F.col("mode"), F.col("block"), F.col("mode").isNotNull())
    progress = F.when(F.col("progress").isNotNull(), requests.progress(F.col("progress")))
    return b.select("id", requests.page_source(F.col("html")).alias("source"), F.col("f.title").alias("title"), F.col("f.byline").alias("byline"), F.col("v.given").alias("given"), F.col("v.id").alias("voice"), F.col("v.name").alias("name"), start.alias("start"), progress.alias("progress"))


@query(f"""with {src.ARTICLES_SQL} select id, substr(sha256(coalesce(title, '') || chr(31) || coalesce(site_name, '') || chr(31) || coalesce(text_content, '')), 1, 31) as content_revision, case when id % 3 = 0 then 'r' || id end as rev, case when id % 3 = 0 then id + 0.5 end::double as offset_s from articles""")
def narration_state(spark, sf_dir):
    mark = F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"v":1,"rev":"r'), F.col("id").cast("string"), F.lit('","offset_seconds":'), (F.col("id") + 0.5).cast("string"), F.lit("}"))).when(F.col("id") % 3 == 1, F.lit("not json"))
    a = requests.with_narration_state(src.articles(spark, sf_dir).withColumn("audio_bookmark", mark))
    return a.select("id", "content_revision", "bookmark.rev", F.col("bookmark.offset_seconds").alias("offset_s"))


_PROFILES = [("janedoe", '{"primaryPublication":{"subdomain":"one"},"publicationUsers":[{"publication":{"custom_domain":"two.example"}}]}'), ("thepaper", '{"primaryPublication":{"subdomain":"one"}}'), ("paper", '{"publicationUsers":[{"publication":{"subdomain":"three"}}]}')]


@query("select * from (values (1, 'one.substack.com', 1), (1, 'two.example', 2), (1, 'three.substack.com', 3), (2, 'three.substack.com', 1)) t(id, host, rank)")
def profile_hosts(spark, sf_dir):
    c = frame(spark, "id long, byline string, poster string, publication string", [(1, "Jane Doe", None, "The Paper"), (2, None, "Paper", None), (3, None, None, "x")])
    return requests.profile_hosts(c, frame(spark, "handle string, profile string", _PROFILES))


@query()
def drop_caps(spark, sf_dir):
    """Which paragraph of each page opens with a drop cap."""
    rows = extract.article_rows(src.table(spark, sf_dir, "pages"))
    return rows.select("url", F.udf(extract.drop_cap, T.IntegerType(), useArrow=True)("content_html").alias("paragraph"))


@query("""select conv_id as script, turn, substr(sha256('{"bitrate":96,"model":"plain","speed":1.0,"temperature":0.7,"top_p":0.7,"version":3}' || chr(31) || coalesce(text, '')), 1, 31) as revision from conversations""")
def segment_revisions(spark, sf_dir):
    """Every turn of the conversations by how it is synthesised and what is said."""
    config = requests.synthesis_config("plain", 96, 1.0, 0.7, 0.7, 3)
    return src.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("script"), "turn", requests.segment_revision(config, F.col("text")).alias("revision"))


@query("""with recursive u as (select user_id as key, event_id as ord, (event_id * 7) % 5 as expected, case event_id % 6 when 0 then 'cleared' when 2 then 'refused' when 3 then 'refused' else 'set' end as given, case when event_id % 6 in (1, 4, 5) then 'v' || event_id end as id from events),
a as (select *, row_number() over (partition by key order by ord) as k from u where given <> 'refused'),
f as (select key, 0::bigint as k, null::bigint as ord, 0::bigint as version, null::varchar as voice, null::varchar as outcome from (select distinct key from a)
  union all select a.key, a.k, a.ord, case when a.expected = f.version then f.version + 1 else f.version end, case when a.expected = f.version then a.id else f.voice end, case when a.expected = f.version then a.given else 'conflict' end from f join a on a.key = f.key and a.k = f.k + 1)
select key, ord, outcome, version, voice from f where k > 0 union all select key, ord, given, null, null from u where given = 'refused'""")
def voice_overrides(spark, sf_dir):
    """Each event as a write of its user's voice: set, cleared, refused for what is no voice, or in conflict with a newer version."""
    e = src.table(spark, sf_dir, "events")
    kind, own = F.col("event_id") % 6, F.concat(F.lit("v"), F.col("event_id").cast("string"))
    voice = F.when(kind == 1, F.concat(F.lit("  "), own, F.lit(" "))).when(kind == 2, F.lit(" ")).when(kind == 3, F.concat(own, F.lit("\x07x"))).when(kind > 3, own)
    return requests.voice_overrides(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), ((F.col("event_id") * 7) % 5).alias("expected"), voice.alias("id"), F.col("event_type").alias("name")))


@query(f"""with {src.ARTICLES_SQL}, w as (select id as ord, word_count % 7 <> 0 as ok from articles where len(tags) = 0 and text_content <> '')
select ord, ok, count(*) filter (where ok) over (order by ord) as done, count(*) filter (where not ok) over (order by ord) as failed from w""")
def backlog_run(spark, sf_dir):
    """The untagged articles worked through in order, with how many were done and failed at each."""
    a = src.articles(spark, sf_dir).where((F.size("tags") == 0) & (F.col("text_content") != ""))
    return requests.backfill(a.select(F.col("id").alias("ord"), (F.col("word_count") % 7 != 0).alias("ok")))
