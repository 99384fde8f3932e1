"""Queries over pages and attempts at reading them."""

from pyspark.sql import functions as F

from leafmill.operators import extract as x
from leafmill.operators import narration
from leafmill.plans.base import frame, query, values
from leafmill.sources import adapters as src

_TEXT = r"""t as (select page_id as id, url, html, regexp_replace(regexp_replace(html, '<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g') as x from pages),
p as (select id, url, html, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\n\x0B\f\r\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) as text from t)"""


@query(f"with {_TEXT} select id, sha256(text) as text_sha256, length(text) as n_chars from p")
def html_text(spark, sf_dir):
    t = src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), x.html_text(F.col("html")).alias("t"))
    return t.select("id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("n_chars"))


@query(f"with {_TEXT} select id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) as words from p")
def html_wordcount(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), x.words_of(x.html_text(F.col("html"))).alias("words"))


@query(r"""with t as (select page_id as id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as t from pages) select id, case when t = '' then url else t end as title, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '') as site_name from t""")
def html_title_fallback(spark, sf_dir):
    from leafmill.functions import urls

    return src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), x.title_fallback(F.col("html"), F.col("url")).alias("title"), urls.host_label(F.col("url")).alias("site_name"))


_TRIES = "select page_id, url, unnest([0, 1, 2, 3]) as ord from pages"


def _attempts(spark, sf_dir):
    pages = src.table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, range(4)))).alias("ord"))
    words = ((F.col("page_id") * 37 + F.col("ord") * 101) % 1000).cast("long")
    strategy = F.array(*map(F.lit, ("direct", "crawler", "amp", "archive")))[F.col("ord")]
    return x.worthwhile(pages.select("page_id", "url", "ord", strategy.alias("strategy"), (words > 700).alias("ok"), words.alias("word_count"), F.when(words <= 700, F.when(words < 120, "too short").otherwise("paywalled")).alias("reason")))


_ATTEMPTS = f"""a as (select page_id, url, ord, ['direct', 'crawler', 'amp', 'archive'][ord + 1] as strategy, (page_id * 37 + ord * 101) % 1000 as word_count from ({_TRIES})),
b as (select *, word_count > 700 as ok, case when word_count <= 700 then case when word_count < 120 then 'too short' else 'paywalled' end end as reason from a where not (regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '\\.pdf$') and strategy in ('amp', 'archive')))"""


@query(f"""with {_ATTEMPTS}, r as (select *, row_number() over (partition by url order by ok desc, case when ok then 0 else -word_count end, ord) as r, string_agg(case when not ok then strategy || ': ' || reason end, '; ' order by ord) over (partition by url rows between unbounded preceding and unbounded following) as reasons from b)
select url, strategy, ok, word_count, case when ok then '' else reasons end as reasons from r where r = 1""")
def best_attempt(spark, sf_dir):
    return x.best_attempt(_attempts(spark, sf_dir), "page_id")


@query(f"with {_ATTEMPTS} select page_id, strategy from (select *, row_number() over (partition by page_id order by ord) as r from b where ok) where r = 1")
def first_ok_attempt(spark, sf_dir):
    ok = _attempts(spark, sf_dir).where("ok")
    return ok.groupBy("page_id").agg(F.min_by("strategy", "ord").alias("strategy"))


@query(r"""with t as (select doc_id as id, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda z: regexp_replace(z, '^\s+|\s+$', '', 'g')), lambda z: z <> '') as l from documents),
e as (select id, list_transform(l, lambda z: replace(replace(replace(z, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as l from t)
select id, sha256(case when len(l) > 0 then '<html><head><title>' || l[1] || '</title></head><body><article><h1>' || l[1] || '</h1>' || array_to_string(list_transform(l[2:], lambda z: '<p>' || z || '</p>'), '') || '</article></body></html>' else '' end) as html_sha256 from e""")
def plain_text_html(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(x.plain_text_html(F.col("text")), 256).alias("html_sha256"))


_SOURCES = [(1, "<p>x</p>"), (2, "a < b and c > d"), (3, "plain"), (4, "</DIV >"), (5, None), (6, "x" * 4000 + "<p>")]


@query(rf"with {values('c', 'id long, t string', _SOURCES)} select id, regexp_matches(substr(coalesce(t, ''), 1, 4000), '(?is)</?[a-z].*>') as html from c")
def html_detect(spark, sf_dir):
    return frame(spark, "id long, t string", _SOURCES).select("id", x.looks_like_html(F.col("t")).alias("html"))


_HEADS = [
    (1, '<head><link rel="canonical" href="https://a.example/x"><meta property="og:url" content="https://a.example/og"><meta content="https://a.example/i.png" property="og:image"><meta property="article:published_time" content="2024-01-02"></head>', "https://a.example/1"),
    (2, '<head><script type="application/ld+json">{"@graph":[{"datePublished":"2023-05-06"}]}</script></head>', "https://b.example/2"), (3, "<head></head>", "https://c.example/3"), (4, '<meta property="og:url" content="ftp://x">', "https://d.example/"),
]


@query("""select * from (values (1, 'https://a.example/x', 'https://a.example/i.png', '2024-01-02', 'https://a.example/og'), (2, null, null, '2023-05-06', null), (3, null, null, null, null), (4, null, null, null, null)) t(id, canonical, lead_image, published_at, origin)""")
def html_meta(spark, sf_dir):
    rows = frame(spark, "id long, html string, url string", _HEADS).withColumn("m", x.head_meta(F.col("html")))
    return rows.select("id", "m.canonical", "m.lead_image", "m.published_at", x.captured_origin(F.lit(None).cast("string"), F.col("m.og_url"), F.col("m.canonical")).alias("origin"))


_STUBS = [(1, "https://www.a.example/x", None, None, None, None), (2, "https://b.example/", "A title", "By B", "a wall", "An excerpt")]


@query(rf"""with {values("c", "id long, url string, title string, byline string, note string, excerpt string", _STUBS)}, s as (select *, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '') as site from c)
select id, coalesce(title, site) as title, site as site_name, coalesce(excerpt, 'saved as a link — ' || site) as excerpt, array_to_string(list_filter([coalesce(title, site), byline, site, excerpt], lambda z: z is not null), '. ') as text_content, coalesce(note, 'saved as a link; the page could not be read') as quality_note from s""")
def link_stubs(spark, sf_dir):
    rows = frame(spark, "id long, url string, title string, byline string, note string, excerpt string", _STUBS)
    s = rows.select("id", x.link_stub(*[F.col(c) for c in ("url", "title", "byline", "note", "excerpt")]).alias("s"))
    return s.select("id", "s.title", "s.site_name", "s.excerpt", "s.text_content", "s.quality_note")


_PDFS = [(1, True, 10, False, 0), (2, False, 400, True, 0), (3, False, 400, True, 7), (4, False, 9, False, 2)]


@query(f"""with {values("c", "id long, ok boolean, pages int, truncated boolean, unread int", _PDFS)}
select id, nullif(concat_ws('; ', case when truncated then 'only part of this ' || pages || '-page PDF was read' end, case when unread > 0 then unread || ' scanned page(s) went unread' end), '') as note from c""")
def pdf_notes(spark, sf_dir):
    return frame(spark, "id long, ok boolean, pages int, truncated boolean, unread int", _PDFS).select("id", x.pdf_notes(F.col("ok"), F.col("pages"), F.col("truncated"), F.col("unread")).alias("note"))


@query()
def article_extract(spark, sf_dir):
    """Every page as an article row, from one parse."""
    return x.article_rows(src.table(spark, sf_dir, "pages"))


@query()
def narration_blocks(spark, sf_dir):
    """Every page's article as blocks, spoken or left out and why."""
    pages = src.table(spark, sf_dir, "pages")
    rows = x.article_rows(pages).select(F.xxhash64("url").alias("id"), "title", "site_name", F.lit(None).cast("string").alias("byline"), "content_html")
    return narration.blocks(rows)


@query()
def narration_script(spark, sf_dir):
    """Every document, read as an article of paragraphs, as passages with offsets, pauses and pacing."""
    docs = src.articles(spark, sf_dir).select("id", "title", "site_name", "byline", x.plain_text_html(F.col("text_content")).alias("content_html"))
    return narration.script(narration.blocks(docs, cuts=(narration.TARGET, narration.MOST)))


@query()
def speech_rewrite(spark, sf_dir):
    """Every line of the documents as it is spoken."""
    lines = src.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", narration.speakable_udf("line").alias("spoken"))


@query()
def split_passages(spark, sf_dir):
    """Every document cut into passages of at most 450 characters."""
    return narration.passages(src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def lenient_json(spark, sf_dir):
    """Objects out of replies that hold more, or less, than an object: event properties, some fenced, some cut off."""
    e = src.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"a": ['), "props", F.lit(", {"))).otherwise(F.col("props")).alias("reply"))
    return e.select("event_id", narration.lenient_json_udf("reply").alias("object"))
