"""Queries over the library."""

from pyspark.sql import functions as F

from leafmill.operators import library as lib
from leafmill.operators import search
from leafmill.plans.base import frame, query, values
from leafmill.sources import adapters as src
from leafmill.sources.shared import fresh_dir
from leafmill.sources.store import Store

NOW = "2024-02-10 00:00:00"
WITH = f"with {src.ARTICLES_SQL}, {src.COLLECTIONS_SQL}, {src.MEMBERS_SQL}"
LISTS = "coalesce((select string_agg(collection_id::varchar, ',' order by collection_id) from article_collections ac where ac.article_id = p.id), '') as collections"


def lists(df):
    return df.withColumn("collections", F.array_join(F.transform("collections", lambda x: x.cast("string")), ","))


def _opens(prefix):
    """Whether a token of an article begins so, in its folded form; for prefixes that stemming leaves alone."""
    columns = ("title", "byline", "site_name", "text_content", "'[\"' || array_to_string(tags, '\",\"') || '\"]'")
    return "(" + " or ".join(f"coalesce(regexp_matches(strip_accents(lower({c})), '(?:^|[^\\p{{L}}\\p{{N}}]){prefix}'), false)" for c in columns) + ")"


def _index(spark, sf_dir):
    return search.stored_index(spark, sf_dir, lambda: src.articles(spark, sf_dir))


@query(f"""{WITH}, p as (select * from articles where read_at is null and not archived and {_opens("the")} and {_opens("er")} order by saved_at desc, id desc limit 500)
select id, title, site_name, saved_at, {LISTS} from p""")
def library_search(spark, sf_dir):
    """A page of the articles that the stored index finds; searches scan no text."""
    page = lib.library_page(src.articles(spark, sf_dir), src.article_collections(spark, sf_dir), search.search(_index(spark, sf_dir), "the ER"), "unread")
    return lists(page).select("id", "title", "site_name", "saved_at", "collections")


def _view(name, where):
    @query(f"{WITH} select id, url, site_name, saved_at, favorite, archived from articles where {where} order by saved_at desc, id desc limit 500")
    def run(spark, sf_dir):
        return lib.newest(lib.view(src.articles(spark, sf_dir), name).select("id", "url", "site_name", "saved_at", "favorite", "archived"))

    return run


def _views():
    from leafmill.plans.base import ORACLES, QUERIES

    for name, where in (("unread", "read_at is null and not archived"), ("read", "read_at is not null and not archived"), ("favorites", "favorite"), ("archived", "archived"), ("all", "not archived")):
        _view(name, where)
        QUERIES[f"library_view_{name}"], ORACLES[f"library_view_{name}"] = QUERIES.pop("run"), ORACLES.pop("run")


_views()


@query(f"{WITH} select id, title from articles where not archived and id in (select article_id from article_collections where collection_id = 3) order by saved_at desc, id desc limit 500")
def library_collection(spark, sf_dir):
    return lib.newest(lib.view(src.articles(spark, sf_dir), "collection:3", src.article_collections(spark, sf_dir)).select("id", "title", "saved_at")).select("id", "title")


@query(f"{WITH} select id from articles where instr(lower(title), 'the er') > 0 or instr(lower(site_name), 'the er') > 0 or coalesce(instr(lower(byline), 'the er') > 0, false) or instr(lower(text_content), 'the er') > 0")
def library_substring_search(spark, sf_dir):
    return lib.substring_search(src.articles(spark, sf_dir), " The er ").select("id")


@query(f"{WITH} select c.id, c.name, c.position, (select count(*) from article_collections ac join articles a on a.id = ac.article_id where ac.collection_id = c.id and not a.archived) as count from collections c")
def collection_counts(spark, sf_dir):
    return lib.collection_counts(src.collections(spark), src.article_collections(spark, sf_dir), src.articles(spark, sf_dir))


@query(f"{WITH} select id, {LISTS} from articles p")
def membership_nest(spark, sf_dir):
    return lists(lib.with_collections(src.articles(spark, sf_dir).select("id"), src.article_collections(spark, sf_dir)))


@query(f"{WITH} select a.id, coalesce(string_agg(c.name, ' · ' order by c.position, c.id), '') as lists from articles a left join article_collections ac on ac.article_id = a.id left join collections c on c.id = ac.collection_id group by a.id")
def collection_names(spark, sf_dir):
    return lib.collection_names(src.articles(spark, sf_dir), src.article_collections(spark, sf_dir), src.collections(spark))


@query(f"{WITH} select id, saved_at from articles where len(tags) = 0 and text_content <> ''")
def untagged_backlog(spark, sf_dir):
    return lib.untagged(src.articles(spark, sf_dir)).select("id", "saved_at")


@query(f"{WITH} select count(*) filter (where len(tags) = 0 and text_content <> '') as untagged, count(*) as total, count(*) filter (where len(tags) > 0) as done from articles")
def backlog_status(spark, sf_dir):
    a = src.articles(spark, sf_dir)
    waiting = (F.size("tags") == 0) & (F.col("text_content") != "")
    return a.agg(F.count_if(waiting).alias("untagged"), F.count(F.lit(1)).alias("total"), F.count_if(F.size("tags") > 0).alias("done"))


@query(f"{WITH} select id, word_count, greatest(1, floor(word_count / 230 + 0.5))::bigint as minutes from articles")
def reading_minutes(spark, sf_dir):
    return src.articles(spark, sf_dir).select("id", "word_count", lib.reading_minutes(F.col("word_count")).alias("minutes"))


@query(f"""{WITH}, d as (select id, saved_at, date_diff('day', saved_at::date, date '2024-02-10') as n from articles)
select id, case when n <= 0 then 'today' when n = 1 then 'yesterday' when n < 30 then n || 'd ago' else strftime(saved_at, '%Y-%m-%d') end as saved from d""")
def relative_date(spark, sf_dir):
    return src.articles(spark, sf_dir).select("id", lib.relative_date(F.col("saved_at"), F.lit(NOW).cast("timestamp")).alias("saved"))


_MARKERS = " ".join(f"when contains(head, '{m.replace(chr(39), chr(39) * 2)}') then '{m.replace(chr(39), chr(39) * 2)}'" for m in lib.PAYWALL_MARKERS)
_WALLS = [(1, "Read on. Subscribe to continue reading this story.", 40), (2, "You've reached your limit. Get unlimited access", 799), (3, "You have reached your limit", 800), (4, "plain", 119), (5, "plain", 120), (6, None, 0)]


@query(f"""with {src.ARTICLES_SQL}, {values("walls", "id long, t string, n long", _WALLS)},
r as (select id, text_content as t, word_count as n from articles union all select -id, t, n from walls), h as (select id, n, lower(substr(coalesce(t, ''), 1, 4000)) as head from r), m as (select id, n, case {_MARKERS} end as marker from h)
select id, case when marker is not null and n < 800 then marker when n < 120 then 'too short' end as verdict from m""")
def paywall_verdict(spark, sf_dir):
    rows = src.articles(spark, sf_dir).select("id", F.col("text_content").alias("t"), F.col("word_count").alias("n")).unionByName(frame(spark, "id long, t string, n long", _WALLS).withColumn("id", -F.col("id")))
    return rows.select("id", lib.paywall_verdict(F.col("t"), F.col("n")).alias("verdict"))


_SCRIPTS = [(1, "これはテストです"), (2, "한국어 문장입니다"), (3, "这是一个中文句子"), (4, "Это русский текст"), (5, "هذا نص عربي"), (6, "plain words"), (7, ""), (8, None)]


@query(f"""with {values("s", "id long, t string", _SCRIPTS)}, r as (select doc_id as id, text as t from documents union all select -id, t from s),
h as (select id, substr(t, 1, 4000) as x from r), c as (select id, greatest(len(regexp_extract_all(x, '\\p{{L}}')), 1) as n, x from h)
select id, case when len(regexp_extract_all(x, '[\\x{{3040}}-\\x{{30ff}}]')) / n > 0.05 then 'ja' when len(regexp_extract_all(x, '[\\x{{ac00}}-\\x{{d7af}}]')) / n > 0.05 then 'ko'
  when len(regexp_extract_all(x, '[\\x{{4e00}}-\\x{{9fff}}]')) / n > 0.1 then 'zh' when len(regexp_extract_all(x, '[\\x{{0400}}-\\x{{04ff}}]')) / n > 0.2 then 'ru'
  when len(regexp_extract_all(x, '[\\x{{0600}}-\\x{{06ff}}]')) / n > 0.2 then 'ar' else 'en' end as lang from c""")
def language_script_detect(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")).unionByName(frame(spark, "id long, t string", _SCRIPTS).withColumn("id", -F.col("id")))
    return rows.select("id", lib.script_language(F.col("t")).alias("lang"))


@query(f"{WITH} select id, substr(sha256(coalesce(title, '') || chr(31) || coalesce(site_name, '') || chr(31) || coalesce(text_content, '')), 1, 31) as revision from articles")
def content_revision(spark, sf_dir):
    return src.articles(spark, sf_dir).select("id", lib.content_revision(F.col("title"), F.col("site_name"), F.col("text_content")).alias("revision"))


@query(f"{WITH} select id, url, title, word_count from articles where id = 17 or url = 'https://src3.example.org/en/23'")
def point_lookup(spark, sf_dir):
    a = src.articles(spark, sf_dir)
    return a.where((F.col("id") == 17) | (F.col("url") == "https://src3.example.org/en/23")).select("id", "url", "title", "word_count")


@query(f"{WITH}, {src.CACHE_SQL} select id from articles where id in (select article_id from audio_cache)")
def has_audio(spark, sf_dir):
    audio = src.audio_cache(spark, sf_dir).select(F.col("article_id").alias("id"))
    return src.articles(spark, sf_dir).select("id").join(audio, "id", "left_semi")


@query(f"""{WITH} select id, case when word_count < 60 then 'stub' when word_count < 150 then 'partial' else '' end as badge,
  progress > 0.02 and progress < 0.97 as shows_progress, array_to_string(tags, ',') as tags, favorite, archived from articles""")
def row_badges(spark, sf_dir):
    quality = F.when(F.col("word_count") < 60, "stub").when(F.col("word_count") < 150, "partial").otherwise("full")
    return src.articles(spark, sf_dir).select("id", lib.badge(quality).alias("badge"), lib.shows_progress(F.col("progress")).alias("shows_progress"), F.array_join("tags", ",").alias("tags"), "favorite", "archived")


@query(f"""with {src.COLLECTIONS_SQL} select (select coalesce(max(position), 0) + 1 from collections) as next, (select coalesce(max(position), 0) + 1 from collections where id > 99) as first""")
def list_positions(spark, sf_dir):
    c = src.collections(spark)
    return lib.next_position(c).crossJoin(lib.next_position(c.where("id > 99")).withColumnRenamed("next", "first"))


_RENAMES = [(1, "  list 2 "), (2, "LIST 2"), (3, "   "), (4, "Longreads"), (5, "x" * 60), (1, "LÏST 3")]


@query(f"""with {src.COLLECTIONS_SQL}, {values("w", "id long, new_name string", _RENAMES)}, c as (select id as wid, substr(trim(new_name), 1, 40) as clean from w)
select wid, clean, case when clean = '' then 'empty' when exists (select 1 from collections o where translate(o.name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(clean, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') and o.id <> wid) then 'taken' else 'ok' end as verdict from c""")
def list_name_clashes(spark, sf_dir):
    return lib.name_clashes(src.collections(spark), frame(spark, "id long, new_name string", _RENAMES))


@query("""with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
k as (select doc_id, pos, lower(trim(line)) as key from lines)
select doc_id, pos, substr(md5(key), 1, 16) as key, row_number() over (partition by doc_id, key order by pos) - 1 as occurrence from k""")
def occurrence_ids(spark, sf_dir):
    lines = src.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lower(F.trim("line")).alias("k"))
    return keyed.select("doc_id", "pos", F.substring(F.md5("k"), 1, 16).alias("key"), lib.occurrence(["doc_id", "k"], ["pos"]).cast("long").alias("occurrence"))


# Porter leaves `the` of `thes` as well
_PHRASE = "thes?[^\\p{L}\\p{N}]+s"


@query(f"{WITH} select id as doc_id from articles where {_opens(_PHRASE)} and {_opens('er')} and {_opens('good')}")
def fts_porter(spark, sf_dir):
    """Full-text search as the reference's index answers it: folded, stemmed, prefixes, phrases in one column."""
    return search.search(_index(spark, sf_dir), "the-s er good")


_CHANGED = "select * replace (case when id % 100 = 7 then 'The stirring of ' || site_name else title end as title) from articles where id % 100 <> 13"


@query(f"{WITH}, cur as ({_CHANGED}) select id as doc_id, title from cur where {_opens(_PHRASE)} and {_opens('er')}")
def fts_after_changes(spark, sf_dir):
    """A search after every hundredth article got another title and every other hundredth went: only the former are indexed anew."""
    a = src.articles(spark, sf_dir)
    index = search.LivingIndex(Store(spark, fresh_dir(spark, "living")))
    index.create(a)
    changed = a.where("id % 100 = 7").withColumn("title", F.concat(F.lit("The stirring of "), "site_name"))
    index.update(changed, a.where("id % 100 = 13").select("id"))
    titles = a.where("id % 100 <> 13").select("id", F.when(F.col("id") % 100 == 7, F.concat(F.lit("The stirring of "), "site_name")).otherwise(F.col("title")).alias("title"))
    return index.search("the-s er").join(titles, F.col("doc_id") == F.col("id")).select("doc_id", "title")


@query()
def fts_postings_refresh(spark, sf_dir):
    """Postings after some articles changed: only those are tokenised again."""
    a = src.articles(spark, sf_dir)
    old = search.postings(a, ["title"])
    changed = a.where("id % 10 = 0").withColumn("title", F.concat(F.lit("Revised "), "title"))
    return search.refreshed(old, changed, ["title"]).groupBy("token").agg(F.count_distinct("doc_id").alias("docs"))
