"""Queries about voices and their delivery."""

from pyspark.sql import functions as F

from leafmill.functions import identity
from leafmill.operators import mp3
from leafmill.operators import voice as v
from leafmill.plans.base import frame, query, values
from leafmill.sources import adapters as src

_VOICES = f"with {src.VOICES_SQL}"
WANT, CLASH = "brushed steel economy polished tin".split(), "promo copper".split()


def _count(names):
    return "len(list_filter(tags, lambda t: list_contains([" + ", ".join(f"'{n}'" for n in names) + "], t)))"


_SCORE = f"""case when {_count(WANT)} > 0 then 3 * 2.0 * {_count(WANT)} / ({len(WANT)} + len(tags)) else 0 end + least(2, {_count(v.READS_PROSE)}) * 0.35 - least(3, {_count(v.OFF_REGISTER)}) * 0.3
  - least(3, {_count(CLASH)}) * 0.2 + least(0.15, log10(1 + popularity) / 50) + (id * 7919 % 1000) / 1667.0 - case when id % 50 = 0 then 1.1 else 0 end"""


def _scored():
    return v.voice_score(F.col("tags"), F.col("popularity"), (F.col("id") * 7919 % 1000) / 1667.0, F.col("id") % 50 == 0, WANT, CLASH)


@query(f"{_VOICES} select id, round({_SCORE}, 6) as score from voices")
def voice_score(spark, sf_dir):
    return src.voices(spark, sf_dir).select("id", F.round(_scored(), 6).alias("score"))


@query(f"""{_VOICES}, s as (select id, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as key, {_SCORE} as score from voices), b as (select *, row_number() over (partition by key order by round(score, 9) desc, id) as r from s)
select id, key, rank, rank <= 6 as suits from (select id, key, row_number() over (order by round(score, 9) desc, id) as rank from b where r = 1)""")
def voice_rank(spark, sf_dir):
    return v.ranked(src.voices(spark, sf_dir), F.round(_scored(), 9)).select("id", "key", "rank", "suits")


@query(f"{_VOICES} select regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') as key, count(*) as clones, min(id) as first from voices group by 1")
def voice_clone_collapse(spark, sf_dir):
    return src.voices(spark, sf_dir).groupBy(v.voice_key(F.col("title"), F.col("id")).alias("key")).agg(F.count(F.lit(1)).alias("clones"), F.min("id").alias("first"))


@query(f"""{_VOICES}, p as (select 1 + id % 3 as page, id % 1500 as id, id as pos, title from voices where id % 4 <> 3), n as (select id, title, true as fresh from (select *, row_number() over (partition by id order by page, pos) as r from p) where r = 1),
o as (select id % 1700 as id, min(title) as title from voices group by 1) select id, title, fresh from n union all select id, title, false from o where id not in (select id from n)""")
def catalogue_merge(spark, sf_dir):
    pages = src.voices(spark, sf_dir).where("id % 4 <> 3").select((1 + F.col("id") % 3).alias("page"), F.col("id").alias("pos"), (F.col("id") % 1500).alias("id"), "title")
    old = src.voices(spark, sf_dir).groupBy((F.col("id") % 1700).alias("id")).agg(F.min("title").alias("title"))
    return v.catalogue_merge(pages, old, any_failed=True)


@query(f"""{_VOICES}, r as (select id % 300 as id, ['default', 'article', 'locked'][1 + id % 3] as role, id as ord from voices where id % 11 = 0)
select v.id, (select role from r where r.id = v.id order by ord limit 1) as role from voices v""")
def catalogue_roles(spark, sf_dir):
    names = F.array(*map(F.lit, ("default", "article", "locked")))
    roles = src.voices(spark, sf_dir).where("id % 11 = 0").select((F.col("id") % 300).alias("id"), names[(F.col("id") % 3).cast("int")].alias("role"), F.col("id").alias("ord"))
    return v.with_roles(src.voices(spark, sf_dir).select("id"), roles)


_CHOICE = {"lock": 17, "own": 7, "default_voice": 5, "saved_auto": 3, "configured": 2, "fresh_auto": 1}


@query("with c as (select doc_id as id, " + ", ".join(f"case when doc_id % {n} = 0 and doc_id % 19 <> 0 then '{k}' || doc_id end as {k}" for k, n in _CHOICE.items()) + " from documents) select id, coalesce(" + ", ".join(_CHOICE) + ") as voice, case " + " ".join(f"when {k} is not null then '{k}'" for k in _CHOICE) + " else 'provider' end as source from c")
def voice_precedence(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    cols = [F.when((F.col("doc_id") % n == 0) & (F.col("doc_id") % 19 != 0), F.concat(F.lit(k), F.col("doc_id").cast("string"))).alias(k) for k, n in _CHOICE.items()]
    return v.chosen_voice(d.select(F.col("doc_id").alias("id"), *cols))


_RATED = [(1, "A", ["calm"], "trained", "public", False), (2, "", ["calm"], "trained", "public", False), (3, "My clone", ["calm"], "trained", "public", False), (4, "B", [], "trained", "public", False), (5, "C", ["calm", "cartoon"], "trained", "public", False), (6, "D", ["calm"], "training", "public", None), (7, "E", ["host"], "trained", "private", None), (8, "F", ["host"], "trained", "public", None), (9, "G", ["host"], "trained", "public", True)]


@query(f"""with {values("c", "id long, title string, tags array<string>, state string, visibility string, taken_down boolean", _RATED)}
select id from c where state = 'trained' and visibility = 'public' and not coalesce(taken_down, false) and title <> '' and not regexp_matches(lower(title), 'test|clone|demo') and len(tags) > 0 and not list_has_any(tags, {v.UNSUITABLE!r})""")
def voice_suitability(spark, sf_dir):
    return v.usable(frame(spark, "id long, title string, tags array<string>, state string, visibility string, taken_down boolean", _RATED)).select("id")


_TONES = " ".join(f"when regexp_matches(t, '(?i)(?:^|[^A-Za-z0-9_])(?:{w})') then '{n}'" for n, w, *_ in v.PROFILES)
_TONED = [(1, "Markets fall", "News Daily", 100), (2, "A memoir of loss", "x", 3000), (3, "Software for all", "x", 10), (4, "Where to travel", "x", 10), (5, "plain", "x", 2501), (6, "restart", "wart", 1)]


@query(f"""with {src.ARTICLES_SQL}, {values("s", "id long, title string, site string, words long", _TONED)},
c as (select id, concat_ws(' ', title, site_name, array_to_string(tags, ' '), excerpt) as t, word_count as words from articles union all select -id, title || ' ' || site, words from s), p as (select id, words, case {_TONES} else 'general' end as profile from c)
select id, profile, round(case profile when 'reportage' then 1.03 when 'essay' then 0.97 else 1.0 end - case when words > 2500 then 0.03 else 0 end, 4)::double as speed from p""")
def tone_profile(spark, sf_dir):
    a = src.articles(spark, sf_dir).select("id", "title", F.col("site_name").alias("site"), "tags", "excerpt", F.col("word_count").alias("words"))
    s = frame(spark, "id long, title string, site string, words long", _TONED).select((-F.col("id")).alias("id"), "title", "site", F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("excerpt"), "words")
    rows = a.unionByName(s).withColumn("profile", v.tone_profile(F.col("title"), F.col("site"), F.col("tags"), F.col("excerpt")))
    return rows.select("id", "profile", v.pace(F.col("profile"), F.col("words")).alias("speed"))


@query("""with t as (select doc_id as id, doc_id || ':' || source || lang as s from documents), u as (select id, list_concat(list_transform(string_split(s, ''), lambda c: unicode(c)::bigint), [233::bigint, 55357, 56898]) as units from t)
select id, list_reduce(list_prepend(2166136261::bigint, units), lambda h, c: (xor(h, c) * 16777619) & 4294967295) as h from u""")
def fnv_numbers(spark, sf_dir):
    """A number for each document by its key, an accent and a character of two code units."""
    d = src.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), v.hash_number(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "source", "lang", F.lit("é🙂"))).alias("h"))


_REPLIES = [(1, 200, None), (2, 429, "30"), (3, 503, "Wed, 10 Jan 2024 00:00:05 GMT"), (4, 401, "soon"), (5, 404, "-1"), (6, 504, "0"), (7, 402, "Wed, 10 Jan 2023 00:00:05 GMT")]


@query(f"""with {values("c", "id long, status int, header string", _REPLIES)}, r as (select *, try_cast(trim(header) as double) as s, try_strptime(regexp_replace(trim(header), '^\\w+, | GMT$', '', 'g'), '%d %b %Y %H:%M:%S') as due from c)
select id, case when s >= 0 then cast(s * 1000 as bigint) when due is not null then greatest(date_diff('millisecond', timestamp '2024-01-10 00:00:00', due), 0) end as wait_ms, case when status in (401, 403) then 'auth' when status = 402 then 'quota' when status = 429 then 'rate_limited' when status in (408, 504) then 'timeout' when status between 500 and 599 then 'provider_down' when status between 400 and 499 then 'bad_request' else 'unknown' end as class,
  status in (408, 425, 429, 500, 502, 503, 504) as retry, cast(floor(700 * pow(2, id) * (0.5 + id / 10.0::double) + 0.5) as bigint) as backoff_ms from r""")
def provider_errors(spark, sf_dir):
    c = frame(spark, "id long, status int, header string", _REPLIES)
    return c.select("id", v.retry_after(F.col("header"), F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("wait_ms"), v.error_class(F.col("status")).alias("class"), v.is_retryable(F.col("status")).alias("retry"), v.backoff(F.col("id"), F.col("id") / 10.0).alias("backoff_ms"))


@query("select o_orderkey as id, floor(greatest(cast(floor(o_totalprice) as bigint) - 128, 0) / 8.0::double + 0.5) / 1000 as seconds from orders")
def mp3_duration(spark, sf_dir):
    return src.audio_cache(spark, sf_dir).select(F.col("key").alias("id"), v.mp3_seconds(F.col("bytes"), F.lit(128)).alias("seconds"))


@query(f"""with {src.SEGMENTS_SQL}, k as (select script, seq, duration, ['heading', 'text', 'item', 'quote'][1 + (script + seq) % 4] as kind from segments)
select script, seq, round(least(2.0, greatest(0.5, 1.03 * case kind when 'heading' then 0.95 when 'quote' then 0.96 else 1.0 end))::double, 6) as speed, round(least(1.0, greatest(0.1, 0.7 + case when kind = 'quote' then 0.06 else 0 end))::double, 6) as temperature from k""")
def segment_style(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("heading", "text", "item", "quote")))
    s = src.segments(spark, sf_dir).withColumn("kind", kinds[((F.col("script") + F.col("seq")) % 4).cast("int")])
    speed, temperature = v.segment_style(F.col("kind"), F.lit(1.03), F.lit(0.7))
    return s.select("script", "seq", F.round(speed, 6).alias("speed"), F.round(temperature, 6).alias("temperature"))


_CAPS = [(c,) for c in ("", "10", "200", "450", "5000", "x", "-3", "99.5", None)]


@query(f"""with {values("c", "raw string", _CAPS)}, m as (select raw, case when try_cast(raw as double) > 0 and try_cast(raw as double) = floor(try_cast(raw as double)) then greatest(60, least(try_cast(raw as double), 2000))::bigint else 450 end as most from c) select raw, least(300, most) as target, most from m""")
def segment_policy(spark, sf_dir):
    return frame(spark, "raw string", _CAPS).withColumn("p", v.segment_policy(F.col("raw"))).select("raw", "p.target", "p.most")


@query(f"{_VOICES}, f as (select *, row_number() over (order by popularity desc, id) as rank from voices where contains(lower(title || ' ' || array_to_string(tags, ' ')), 'e')) select id, rank from f where rank > 60 and rank <= 120")
def voice_page(spark, sf_dir):
    return v.search_page(src.voices(spark, sf_dir), " E ", 1).select("id", "rank")


@query("with x as (select o_custkey as article_id, o_orderkey % 4 as script_id, o_orderkey as rev, o_orderdate as used, row_number() over (partition by o_custkey, o_orderkey % 4 order by o_orderdate desc, o_orderkey desc) as r from orders) select article_id, script_id, rev, used from x where r = 1")
def latest_variant(spark, sf_dir):
    a = src.audio_cache(spark, sf_dir).select("article_id", (F.col("key") % 4).alias("script_id"), F.col("key").alias("rev"), "used")
    return v.latest_of_script(a)


@query(r"""select doc_id as id, substr(sha256('["' || doc_id || '","3","300","450"]'), 1, 31) as script_id, substr(sha256('["' || source || '",null]'), 1, 12) as text_id, sha1('2 ' || source || ' ' || lang || ' ') as legacy from documents""")
def identities(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), identity.script_id(F.col("doc_id"), 3, 300, 450).alias("script_id"), identity.identity("text", F.col("source"), F.lit(None)).alias("text_id"), identity.legacy_hash(F.col("source"), F.col("lang"), F.lit(None)).alias("legacy"))


_FRAME = bytes([0xFF, 0xFB, 0x50, 0xC4]) + bytes(204)
_AUDIO = [(1, _FRAME * 2), (2, b"ID3\x04\x00\x00\x00\x00\x00\x05" + bytes(5) + _FRAME), (3, _FRAME + b"xxxx"), (4, b"<html>"), (5, b""), (6, None), (7, _FRAME[:100])]


@query("select * from (values (1, true), (2, true), (3, false), (4, false), (5, false), (6, false), (7, true)) t(id, valid)")
def mp3_validity(spark, sf_dir):
    return frame(spark, "id long, b binary", _AUDIO).select("id", mp3.valid_mp3("b").alias("valid"))


@query("""select event_id, '{"k":' || json_extract_string(props, '$.k') || '}' as props from events""")
def stable_properties(spark, sf_dir):
    """Event properties as JSON with ordered keys."""
    return src.table(spark, sf_dir, "events").select("event_id", identity.stable_json("props").alias("props"))
