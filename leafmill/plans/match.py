"""Queries that resolve references."""

from pyspark.sql import functions as F

from leafmill.functions.folding import sql_folded, sql_words, words
from leafmill.operators import match as m
from leafmill.operators.similarity import dice, similar
from leafmill.plans.base import frame, query, values
from leafmill.sources import adapters as src

def _lines(spark, sf_dir):
    """Every line of documents."""
    lines = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.withColumn("line", F.col("line").cast("long"))


_DATES = [(i, d) for i, d in enumerate(["9 APR 2025 AT 16:31", "February 18, 2025", "2025-6-23", "2025-13-40", "posted 2024-02-31 x", "Sept. 3 2019", "31 foo 2020", "", None, "12 december 1899", "x2025-01-02", "Mar 5, 2300"])]
_NAMES = "'jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'"


@query(rf"""with {values("s", "id long, t string", _DATES)}, c as (select doc_id as id, unnest(range(len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as t from documents union all select -1 - id, 0, t from s),
p as (select id, line, t, regexp_extract(t, '(?:^|[^A-Za-z0-9_])(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:$|[^A-Za-z0-9_])', ['y', 'm', 'd']) as a,
  regexp_extract(t, '(?:^|[^A-Za-z0-9_])(\d{{1,2}})\s+((?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?i)[a-z]*\.?\s+(\d{{4}})(?:$|[^A-Za-z0-9_])', ['d', 'm', 'y']) as b,
  regexp_extract(t, '(?:^|[^A-Za-z0-9_])((?i)jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?i)[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:$|[^A-Za-z0-9_])', ['m', 'd', 'y']) as c from c),
k as (select id, line, case when a.y <> '' then a.y when b.y <> '' then b.y else c.y end as y, case when a.y <> '' then a.m when b.y <> '' then list_position([{_NAMES}], lower(b.m))::varchar else list_position([{_NAMES}], lower(c.m))::varchar end as m, case when a.y <> '' then a.d when b.y <> '' then b.d else c.d end as d from p)
select id, line, case when try_cast(y as int) between 1900 and 2200 and try_cast(m as int) between 1 and 12 and try_cast(d as int) between 1 and 31 then y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') end as day from k""")
def loose_dates(spark, sf_dir):
    rows = _lines(spark, sf_dir).unionByName(frame(spark, "id long, t string", _DATES).select((-1 - F.col("id")).alias("id"), F.lit(0).cast("long").alias("line"), "t"))
    return rows.select("id", "line", m.loose_date(F.col("t")).alias("day"))


_TITLES = [(i, t) for i, t in enumerate(["  “A Title”  ", "Something... more", "Something else … ", "News share", "ok", "n/a", None, "Long   spaces\there", "'Quoted' read more", "Unknown"])]


@query(r"""with """ + values("s", "id long, t string", _TITLES) + r""", c as (select doc_id as id, unnest(range(len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as t from documents union all select -1 - id, 0, t from s),
a as (select id, line, trim(regexp_replace(t, '\s+', ' ', 'g')) as t from c), b as (select id, line, case when t <> '' and not regexp_matches(t, '(?i)^(null|undefined|unknown|n/a|none)$') then substr(t, 1, 400) end as clean from a),
d as (select id, line, clean, trim(regexp_replace(regexp_replace(regexp_replace(clean, '(?i)\s*(?:\.{3}|…)\s*(?:more)?\s*$', ''), '(?i)\s+(?:share|subscribe|listen|read more)\s*$', ''), '^["“”''‘’\s]+|["“”''‘’\s]+$', '', 'g')) as x from b)
select id, line, clean, case when length(x) >= 3 then substr(x, 1, 300) end as title from d""")
def clean_titles(spark, sf_dir):
    rows = _lines(spark, sf_dir).unionByName(frame(spark, "id long, t string", _TITLES).select((-1 - F.col("id")).alias("id"), F.lit(0).cast("long").alias("line"), "t"))
    return rows.select("id", "line", m.clean_text(F.col("t")).alias("clean"), m.clean_title(F.col("t")).alias("title"))


_LOGS = [(1, "GET /x?key=abc123&b=1"), (2, "Authorization: Bearer abcdefghijklmnop.q"), (3, "sk-ABCDEFGHIJKLMNOP failed"), (4, "access_token=zzz"), (5, "?API-KEY=q\"&token=t t"), (6, None)]


@query(r"with " + values("c", "id long, t string", _LOGS) + r""", d as (select id, t from c union all select -doc_id - 1, text from documents)
select id, md5(regexp_replace(regexp_replace(t, '([?&](?:key|api[-_]?key|access[-_]?token|token)=)[^&\s"'']+', '\1[redacted]', 'gi'), '\b(sk-|pk-|Bearer\s+)[A-Za-z0-9._-]{12,}', '\1[redacted]', 'g')) as redacted from d""")
def redact(spark, sf_dir):
    rows = frame(spark, "id long, t string", _LOGS).unionByName(src.table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"), F.col("text").alias("t")))
    return rows.select("id", F.md5(m.redacted(F.col("t"))).alias("redacted"))


_LINES = [(i, t) for i, t in enumerate(["Search", "12/34", "9:41 AM", "1.2K", "—", "A headline about search", "x", "Add comment…", "Effects of x", "effect y", "www.example.com/x", "read at conquer1.substack.com now", "https://a.example.org/x).", "see a.b.invalid", "Playlist of"])]


@query("""select * from (values (0, true, null, null), (1, true, null, null), (2, true, null, null), (3, true, null, null), (4, true, null, null), (5, false, null, null), (6, true, null, null), (7, true, null, null), (8, false, null, null), (9, true, null, null),
  (10, false, null, 'example.com'), (11, false, null, 'conquer1.substack.com'), (12, false, 'https://a.example.org/x', 'a.example.org'), (13, false, null, null), (14, true, null, null)) t(id, chrome, url, domain)""")
def screen_lines(spark, sf_dir):
    return frame(spark, "id long, t string", _LINES).select("id", m.is_chrome(F.col("t")).alias("chrome"), m.first_url(F.col("t")).alias("url"), m.first_domain(F.col("t")).alias("domain"))


# all pairs that share an item, a word and how many of it came before; no block
_PAIRS = f"""c as (select item_id as candidate, {sql_words("text")} as w from benchmark),
l as (select doc_id as post, unnest(range(len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as title from documents), p as (select post, line, {sql_words("title")} as w from l),
ci as (select candidate, n, w, row_number() over (partition by candidate, w) as k from (select candidate, len(w) as n, unnest(w) as w from c)), pi as (select post, line, n, w, row_number() over (partition by post, line, w) as k from (select post, line, len(w) as n, unnest(w) as w from p)),
s as (select candidate, post, line, 2.0::double * count(*) / (any_value(ci.n) + any_value(pi.n)) as dice from ci join pi using (w, k) group by all)"""


def _candidates(spark, sf_dir):
    """The passages of benchmark as what was read off a picture."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") % 28).cast("int")).cast("string")
    by = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Jane Doe of the SRC"), (F.col("item_id") % 20).cast("string")))
    return src.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("candidate"), F.col("text").alias("title"), day.alias("published"), by.alias("byline"), F.lit(None).cast("string").alias("subtitle"))


def _posts(spark, sf_dir):
    """Each line of documents as a post's title."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("string")
    by = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("By Jane Doe of the "), F.upper("source"))).when(F.col("doc_id") % 3 == 1, F.lit("By Érik Ravn"))
    d = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post"), day.alias("published"), by.alias("byline"), F.lit(None).cast("string").alias("subtitle"), F.posexplode(F.split("text", "\n")).alias("line", "title"))
    return d.withColumn("line", F.col("line").cast("long"))


@query(f"with {_PAIRS} select candidate, post, line, round(dice, 6) as dice from s where dice >= 0.72")
def dice_match(spark, sf_dir):
    """All lines that are similar enough to a candidate, however they begin."""
    c, p = _candidates(spark, sf_dir), _posts(spark, sf_dir)
    pairs = similar(c.select("candidate", "title"), p.select("post", "line", "title"), m.ACCEPT)
    return pairs.select("candidate", "post", "line", F.round("dice", 6).alias("dice"))


_EVIDENCE = """t as (select s.*, abs(candidate % 28 - post % 28) as days, case when candidate % 2 = 0 and post % 3 = 0 then case when source = 'src' || candidate % 20 then 10.0::double / 11 else 8.0::double / 11 end else 0 end as by_line from s join documents on doc_id = post where dice >= 0.47),
e as (select *, least(1.0::double, greatest(0.0::double, dice + case when days <= 1 then 0.12::double when days <= 30 then 0.0::double else -0.45::double end + case when by_line > 0.6 then 0.08::double else 0.0::double end + 0.0::double)) as score from t)"""


@query(f"""with {_PAIRS}, {_EVIDENCE}, r as (select *, row_number() over (partition by candidate order by score desc, post, line) as r from e)
select candidate, post, line, round(score, 6) as score, score >= 0.72 as accepted, array_to_string(list_filter([case when dice > 0.92 then 'title' end, case when days <= 1 then 'date' end, case when by_line > 0.6 then 'byline' end], lambda x: x is not null), ',') as signals from r where r = 1""")
def best_match(spark, sf_dir):
    """The line that the evidence speaks for most, of each candidate that one could be accepted for."""
    best = m.best_matches(m.scored(_candidates(spark, sf_dir), _posts(spark, sf_dir)))
    return best.select("candidate", "post", "line", F.round("score", 6).alias("score"), "accepted", F.array_join("signals", ",").alias("signals"))


_FOUND = [
    (1, "Discipline Comes From Having No Choice", "2025-04-09", "Jane Doe", None, "Discipline comes from having no choice", "2025-04-10", "Jane Doe", None),
    (2, "Discipline Comes From Having No Choice", "2025-04-09", None, None, "Discipline comes from having no choice", "2025-06-22", None, None),
    (3, "A B C title words", None, None, "the deck here", "A B C other words", None, None, "the deck here"), (4, "nothing shared", None, None, None, "else entirely", None, None, None), (5, "Café olé día", "2025-01-01", "x yy", None, "cafe ole dia", "bad", "x zz", None),
]
_FC = "id long, ct string, cd string, cb string, cs string, ft string, fd string, fb string, fs string"


def _dice_sql(a, b):
    wa, wb = sql_words(a), sql_words(b)
    return f"case when len({wa}) = 0 or len({wb}) = 0 then 0.0 else 2.0 * coalesce((select sum(least(x.c, y.c)) from (select u, count(*) as c from (select unnest({wa}) as u) group by u) x join (select u, count(*) as c from (select unnest({wb}) as u) group by u) y using (u)), 0) / (len({wa}) + len({wb})) end"


@query(rf"""with {values("c", _FC, _FOUND)}, d as (select id, {_dice_sql("ct", "ft")} as t, abs(date_diff('day', try_cast(cd as date), try_cast(fd as date))) as days, {_dice_sql("cb", "fb")} as b, {_dice_sql("cs", "fs")} as s from c),
e as (select id, t, case when t < 0.45 then t else least(1.0, greatest(0.0, t + case when days is null then 0 when days <= 1 then 0.12 when days <= 30 then 0 else -0.45 end + case when b > 0.6 then 0.08 else 0 end + case when s > 0.6 then 0.05 else 0 end)) end as score,
  case when t < 0.45 then '' else array_to_string(list_filter([case when t > 0.92 then 'title' end, case when days <= 1 then 'date' end, case when b > 0.6 then 'byline' end, case when s > 0.6 then 'deck' end], lambda z: z is not null), ',') end as signals from d)
select id, round(score, 6) as score, signals, contains(signals, 'title') and score >= 0.95 and contains(signals, ',') as certain from e""")
def evidence_score(spark, sf_dir):
    c = frame(spark, _FC, _FOUND)

    def sim(a, b):
        return dice(words(F.col(a)), words(F.col(b)))

    d = c.withColumn("m", m.match_detail(sim("ct", "ft"), m.days_apart(F.col("cd"), F.col("fd")), sim("cb", "fb"), sim("cs", "fs")))
    return d.select("id", F.round("m.score", 6).alias("score"), F.array_join("m.signals", ",").alias("signals"), m.is_certain(F.lit("u"), F.lit("x archive"), F.col("m.score"), F.col("m.signals"), F.lit(False)).alias("certain"))


_CERTAIN = [(1, "u", "in the picture", 0.0, [], False), (2, "u", "a", 0.99, ["title"], False), (3, "u", "a", 0.99, ["title", "date"], False), (4, "u", "a", 0.99, ["title"], True), (5, None, "in the picture", 1.0, ["url"], True), (6, "u", "a", 0.94, ["title", "date"], True)]


@query(f"with {values('c', 'id long, url string, via string, score double, signals array<string>, read boolean', _CERTAIN)} select id, url is not null and (via = 'in the picture' or (list_contains(signals, 'title') and score >= 0.95 and (len(signals) >= 2 or read))) as certain from c")
def certain_match(spark, sf_dir):
    c = frame(spark, "id long, url string, via string, score double, signals array<string>, read boolean", _CERTAIN)
    return c.select("id", m.is_certain(*[F.col(x) for x in ("url", "via", "score", "signals", "read")]).alias("certain"))


@query("""with l as (select doc_id, unnest(range(len(string_split(text, chr(10))))) as line, unnest(string_split(text, chr(10))) as t, source from documents),
c as (select doc_id * 100000 + line as id, doc_id % 500 as screen, trim(regexp_replace(t, '\\s+', ' ', 'g')) as title, source as publication, ((doc_id * 7 + line) % 11) / 10.0::double as confidence from l),
k as (select *, row_number() over (partition by screen, lower(title || '|' || publication) order by confidence desc, id) as r from c), t as (select *, row_number() over (partition by screen order by confidence desc, id) as rank from k where r = 1)
select screen, id, title, confidence, rank from t where rank <= 6""")
def candidate_dedupe(spark, sf_dir):
    """Every line of documents as a candidate; a screen's best six."""
    lines = src.table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    title = F.trim(F.regexp_replace("t", r"\s+", " "))
    c = lines.select((F.col("doc_id") * 100_000 + F.col("line")).alias("id"), (F.col("doc_id") % 500).alias("screen"), title.alias("title"), F.lit(None).cast("string").alias("url"), F.col("source").alias("publication"), ((F.col("doc_id") * 7 + F.col("line")) % 11 / 10.0).alias("confidence"))
    return m.deduped(c).select("screen", "id", "title", "confidence", "rank")


_GUESS = [(1, "a.example", "The Culturist", "Élodie B.", None), (2, None, "ab", "The", "Elevated It Girl"), (3, None, None, None, None), (4, "x.example", "Vogue Business", "Vogue Business", "x" * 41)]
_SLUG = "regexp_replace(" + sql_folded("coalesce({n}, '')") + ", '[^a-z0-9]+', '', 'g')"


def _guesses(n):
    s = _SLUG.format(n=n)
    return f"case when length({s}) between 3 and 40 then case when starts_with({s}, 'the') and length({s}) >= 6 then [{s}, substr({s}, 4)] else [{s}] end else []::varchar[] end"


@query(f"""with {values("c", "id long, domain string, publication string, byline string, poster string", _GUESS)},
h as (select id, list_concat(list_concat(list_concat(case when domain is null then []::varchar[] else [domain] end, list_transform({_guesses("publication")}, lambda x: x || '.substack.com')), list_concat(list_transform({_guesses("byline")}, lambda x: x || '.substack.com'), list_transform({_guesses("poster")}, lambda x: x || '.substack.com'))),
  flatten(list_transform({_guesses("publication")}, lambda x: [x || '.com', 'www.' || x || '.com']))) as l from c)
select id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:6], ',') as hosts from h""")
def host_guesses(spark, sf_dir):
    c = frame(spark, "id long, domain string, publication string, byline string, poster string", _GUESS)
    return c.select("id", F.array_join(m.hosts_to_try(*[F.col(x) for x in ("domain", "publication", "byline", "poster")]), ",").alias("hosts"))


_PROFILES = [(1, '{"primaryPublication":{"custom_domain":"https://www.Own.example/x","subdomain":"own"},"publicationUsers":[{"publication":{"subdomain":"second"}},{"publication":{"custom_domain":"bad host"}},{"publication":{"subdomain":"second"}}]}'), (2, "{}"), (3, "not json")]


@query("select * from (values (1, 'www.own.example,second.substack.com'), (2, ''), (3, '')) t(id, hosts)")
def publication_hosts(spark, sf_dir):
    return frame(spark, "id long, j string", _PROFILES).select("id", F.coalesce(F.array_join(m.publication_hosts(F.col("j")), ","), F.lit("")).alias("hosts"))


_ACADEMIC = [(1, "paper", None, None, None, "T"), (2, "newsletter", "Journal of X", None, None, "One two three four"), (3, "unknown", "University Press", None, None, "One two"), (4, "unknown", None, "vol. 3", "x", ""), (5, "article", "Daily", "deck", "plain", "Three little words")]


@query(rf"""with {values("c", "id long, kind string, publication string, subtitle string, excerpt string, title string", _ACADEMIC)}
select id, case kind when 'paper' then true when 'newsletter' then false else regexp_matches(concat_ws(' ', publication, subtitle, excerpt), '(?i)\b(?:university|journal of|proceedings|vol\.?\s*\d|doi|et al|department of)\b') end as academic,
  case when len(regexp_split_to_array(title, '\s+')) >= 4 then title else concat_ws(' ', nullif(title, ''), nullif(subtitle, '')) end as terms from c""")
def academic_candidates(spark, sf_dir):
    c = frame(spark, "id long, kind string, publication string, subtitle string, excerpt string, title string", _ACADEMIC)
    return c.select("id", m.looks_academic(*[F.col(x) for x in ("kind", "publication", "subtitle", "excerpt")]).alias("academic"), m.search_terms(F.col("title"), F.col("subtitle")).alias("terms"))


_RAW = [(1, " “One Title” ", None, "sub", "Pub", "By", "Feb 3, 2024", None, "article", "1.4"), (2, None, "see https://www.a.example.com/p.", None, None, None, None, None, "weird", "x"), (3, "no", None, None, None, None, None, None, None, None), (4, "Fine title", None, None, None, None, "nope", "HTTP://WWW.B.EXAMPLE.ORG/x", "paper", "-3")]
_RAWC = "id long, title string, url string, subtitle string, publication string, byline string, published string, domain string, kind string, confidence string"


@query("""select * from (values (1, 'One Title', null, 'sub', '2024-02-03', null, 'article', 1.0::double), (2, null, 'https://www.a.example.com/p', null, null, 'a.example.com', 'unknown', 0.5), (4, 'Fine title', null, null, null, 'b.example.org', 'paper', 0.0)) t(id, title, url, subtitle, published, domain, kind, confidence)""")
def candidate_normalise(spark, sf_dir):
    return m.candidate(frame(spark, _RAWC, _RAW)).select("id", "title", "url", "subtitle", "published", "domain", "kind", "confidence")


_SCREEN = [
    (1, "9:41", 10, 60), (1, "Discipline Comes from", 100, 50), (1, "Having No Choice", 160, 48), (1, "conquer1.substack.com", 240, 20), (1, "A caption as large", 600, 50), (1, "9 APR 2025 AT 16:31", 700, 20), (1, "Subscribe", 800, 50),
    (2, "read https://b.example.org/x today", 5, 10), (3, "12", 5, 10),
]


@query("""select * from (values (1, 'Discipline Comes from Having No Choice', null, '2025-04-09', 'conquer1.substack.com', 0.3::double), (2, 'read https://b.example.org/x today', 'https://b.example.org/x', null, 'b.example.org', 0.5)) t(screen, title, url, published, domain, confidence)""")
def screen_candidates(spark, sf_dir):
    return m.interpreted(frame(spark, "screen long, text string, y long, height long", _SCREEN))


@query("""with a as (select doc_id % 97 as candidate, doc_id % 3 as stage, doc_id as ord, case when doc_id % 13 = 0 then 'bad host' else 'h' || (doc_id % 5) || '.example' end as host, (doc_id * 31 % 100) / 100.0::double as score from documents),
f as (select *, row_number() over (partition by candidate, host order by stage, ord) as f from a where host <> 'bad host'), n as (select *, row_number() over (partition by candidate order by stage, ord) as n from f where f = 1),
g as (select *, min(case when score >= 0.72 then n end) over (partition by candidate) as g from n where n <= 12), k as (select *, count(*) over (partition by candidate) as asked, row_number() over (partition by candidate order by score desc, n) as r from g where g is null or n <= g)
select candidate, asked, case when score >= 0.72 then host end as host, score from k where r = 1""")
def resolve_stages(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select("doc_id")
    a = d.select((F.col("doc_id") % 97).alias("candidate"), (F.col("doc_id") % 3).alias("stage"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 13 == 0, F.lit("bad host")).otherwise(F.concat(F.lit("h"), (F.col("doc_id") % 5).cast("string"), F.lit(".example"))).alias("host"), ((F.col("doc_id") * 31 % 100) / 100.0).alias("score"))
    return m.staged(a)


@query("""with c as (select doc_id as id, doc_id % 60 as screen, (doc_id * 13 % 17) / 16.0::double as confidence, case when doc_id % 4 <> 0 then 'u' || doc_id end as url, (doc_id * 29 % 23) / 22.0::double as score from documents),
w as (select *, row_number() over (partition by screen order by confidence desc, id) as worth from c), r as (select *, row_number() over (partition by screen order by url is null, score * confidence desc, worth) as rank from w where worth <= 4) select screen, id, rank, worth from r""")
def resolve_order(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    c = d.select("id", (F.col("id") % 60).alias("screen"), ((F.col("id") * 13 % 17) / 16.0).alias("confidence"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("u"), F.col("id").cast("string"))).alias("url"), ((F.col("id") * 29 % 23) / 22.0).alias("score"))
    return m.resolve_order(c).select("screen", "id", "rank", "worth")
