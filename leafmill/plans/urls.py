"""Queries over addresses, headers and first bytes."""

from pyspark.sql import functions as F

from leafmill.functions import urls as u
from leafmill.plans.base import frame, query, values
from leafmill.sources import adapters as src
from leafmill.sources import readers

_CASES = [
    (1, " example.com/a?utm_source=x&b=1&UTM_medium=y#top "), (2, "HTTPS://Example.COM"), (3, "http://example.com:80/x?fbclid=1"), (4, ""), (5, "https://archive.ph/2024/https://news.example.org/story?gclid=2&q=a+b"),
    (6, "https://archive.today/o/abc/https%3A%2F%2Fwww.example.net%2Fp"), (7, "https://archive.is/abcde"), (8, "ftp://example.com/x"), (9, "https://example.com/?ref=x&ref_src=t"), (10, "https://www.example.com/a/b.pdf"), (11, None),
]

_NORMALISED = r"""
t as (select id, regexp_replace(u, '^\s+|\s+$', '', 'g') as t from c),
w as (select id, t, case when regexp_matches(t, '^https?://', 'i') then t else 'https://' || t end as w from t),
x as (select id, t, w, regexp_replace(lower(regexp_extract(w, '^(?i)https?://([^/?#]*)', 1)), '^www\.', '') in ('archive.ph', 'archive.today', 'archive.is', 'archive.li', 'archive.vn', 'archive.fo', 'archive.md') as a,
  regexp_extract(regexp_replace(w, '^(?i)https?://[^/?#]*', ''), '(?i)(?:^|/)(https?:(?://|%2f%2f).+)$', 1) as e from w),
y as (select id, t, case when a and e <> '' then url_decode(e) else w end as url from x),
p as (select id, t, url, lower(regexp_extract(url, '^(?i)(https?)://', 1)) as scheme, lower(regexp_extract(url, '^(?i)https?://([^/?#]*)', 1)) as auth,
  regexp_extract(url, '^(?i)https?://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^(?i)https?://[^?#]*(\?[^#]*)', 1) as query from y),
q as (select *, list_filter(string_split(regexp_replace(query, '^\?', ''), '&'), lambda z: z <> '') as pairs from p),
k as (select *, list_filter(pairs, lambda z: not regexp_matches(z, '^(utm_|fbclid|gclid|mc_cid|mc_eid|ref_|cmpid)', 'i')) as clean from q),
n as (select id, case when t <> '' and scheme <> '' and auth <> '' then scheme || '://' || regexp_replace(auth, case when scheme = 'http' then ':80$' else ':443$' end, '') || case when path = '' then '/' else path end
  || case when len(clean) = len(pairs) then query when len(clean) = 0 then '' else '?' || array_to_string(clean, '&') end end as url from k)"""


@query(f"with {values('s', 'id long, u string', _CASES)}, c as (select page_id as id, url as u from pages union all select -id, u from s), {_NORMALISED} select id, url from n")
def url_normalize(spark, sf_dir):
    rows = src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("u")).unionByName(frame(spark, "id long, u string", _CASES).withColumn("id", -F.col("id")))
    return rows.select("id", u.normalise(F.col("u")).alias("url"))


@query(r"select page_id as id, nullif(regexp_replace(lower(regexp_extract(url, '^(?i)https?://([^/?#]*)', 1)), '^www\.', ''), '') as host from pages")
def url_host(spark, sf_dir):
    return src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), u.host_label(F.col("url")).alias("host"))


@query(f"with c as (select page_id as id, url as u from pages), {_NORMALISED} select url, min(id) as first_id, count(*) as saves, max(id) as last_id from n group by url")
def url_dedupe(spark, sf_dir):
    rows = src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), u.normalise(F.col("url")).alias("url"))
    return rows.groupBy("url").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("saves"), F.max("id").alias("last_id"))


_ARCHIVED = [(i, "https://archive.ph/" + p) for i, p in enumerate(["20240102030405/https://a.example/x?y=1", "newest/https://b.example/", "o/Ab1/https%3A%2F%2Fc.example%2Fz", "Ab1Cd", "https://d.example/q#frag"])] + [(9, "https://example.com/https://e.example/")]


@query(f"""with {values("c", "id long, u string", _ARCHIVED)}, r as (select id, u, regexp_extract(regexp_replace(u, '^https?://[^/?#]*', ''), '(?i)(?:^|/)(https?:(?://|%2f%2f).+)$', 1) as e, u like 'https://archive.ph/%' as a from c)
select id, case when a and e <> '' then url_decode(e) end as original, a as archived, 'https://archive.ph' || regexp_extract(u, '^https?://[^/?#]*([^#]*)', 1) as own, 'https://archive.today' || regexp_extract(u, '^https?://[^/?#]*([^#]*)', 1) as second from r where a""")
def archive_urls(spark, sf_dir):
    rows = frame(spark, "id long, u string", _ARCHIVED).where(u.host(F.col("u")).isin(u.ARCHIVE_HOSTS))
    m = u.mirrors(F.col("u"))
    return rows.select("id", u.embedded_url(F.col("u")).alias("original"), F.lit(True).alias("archived"), m[0].alias("own"), m[1].alias("second"))


_PATHS = [(1, "https://x.example/a/My_Report-2024.pdf"), (2, "https://x.example/"), (3, "https://x.example/caf%C3%A9+menu"), (4, "https://x.example/A.PDF?x=1"), (5, "https://x.example/b.pdf/c")]


@query(rf"""with {values("c", "id long, u string", _PATHS)}, l as (select id, u, regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) as path from c),
n as (select id, u, path, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(url_decode(list_filter(string_split(path, '/'), lambda z: z <> '')[-1]), ''), '\.pdf$', '', 'i'), '[_+-]+', ' ', 'g'), '\s+', ' ', 'g')) as t from l)
select id, case when t = '' then u else t end as title, ends_with(lower(path), '.pdf') as pdf from n""")
def path_titles(spark, sf_dir):
    return frame(spark, "id long, u string", _PATHS).select("id", u.title_from_path(F.col("u")).alias("title"), u.is_pdf(F.col("u")).alias("pdf"))


_HOSTS = [(h,) for h in ("example.com", "a.b-c.example", "localhost", "a@169.254.169.254", "evil.test:8080", "-a.com", "a-.com", "x..com", "A.com", "a" * 64 + ".com", "1.2.3.4", "")]


@query(rf"with {values('c', 'h string', _HOSTS)} select h, length(h) <= 253 and regexp_matches(h, '{u.HOSTNAME}') as valid from c")
def host_validity(spark, sf_dir):
    return frame(spark, "h string", _HOSTS).select("h", u.valid_host(F.col("h")).alias("valid"))


_ADDRESSES = [(a,) for a in ("0.0.0.0", "10.1.2.3", "127.0.0.1", "100.64.0.1", "100.128.0.1", "169.254.169.254", "172.16.0.1", "172.32.0.1", "192.168.1.1", "192.0.2.5", "192.0.3.5", "192.88.99.1", "198.18.0.1", "198.51.100.7", "203.0.113.9", "224.0.0.1", "8.8.8.8", "::", "::1", "::ffff:8.8.8.8", "fd00::1", "fe80::1%eth0", "ff02::1", "2001:db8::1", "2606:4700::1111", "example.com", "1.2.3", "256.1.1.1", "")]


@query(rf"""with {values("c", "a string", _ADDRESSES)}, v as (select a, lower(split_part(a, '%', 1)) as v from c),
p as (select a, v, regexp_matches(v, '^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$') as f, try_cast(split_part(v, '.', 1) as int) as x, try_cast(split_part(v, '.', 2) as int) as y, try_cast(split_part(v, '.', 3) as int) as z from v)
select a, case when f then x in (0, 10, 127) or x >= 224 or (x = 100 and y between 64 and 127) or (x = 169 and y = 254) or (x = 172 and y between 16 and 31) or (x = 192 and y = 168) or (x = 192 and y = 0 and z in (0, 2)) or (x = 192 and y = 88 and z = 99) or (x = 198 and y in (18, 19)) or (x = 198 and y = 51 and z = 100) or (x = 203 and y = 0 and z = 113)
  when regexp_matches(v, '^[0-9a-f:.]*:[0-9a-f:.]*$') and length(v) >= 2 then v in ('::', '::1') or regexp_matches(v, '^(?:::ffff:|fc|fd|fe[89ab]|ff|64:ff9b:|2001:0:|2001:db8:|2002:)') else true end as private from p""")
def private_address(spark, sf_dir):
    return frame(spark, "a string", _ADDRESSES).select("a", u.is_private(F.col("a")).alias("private"))


_MAPS = [
    (1, '<http://a.example/>; rel="original", <http://web.example/1/http://a.example/>; rel="first memento"; datetime="Mon, 01 Jan 2024 10:00:00 GMT", <http://web.example/2/http://a.example/>; rel="memento"; datetime="Tue, 06 Feb 2024 10:00:00 GMT"'),
    (2, '<http://w.example/9/x>; rel="last memento"; datetime="Mon, 01 Jan 2024 10:00:00 GMT", <http://w.example/10/x>; rel="memento"; datetime="Tue, 06 Feb 2024 10:00:00 GMT"'),
    (3, '<http://a.example/>; rel="original"'), (4, ""),
]


@query(rf"""with {values("c", "id long, t string", _MAPS)}, e as (select id, unnest(regexp_extract_all(t, '<[^>]+>\s*;\s*rel="[^"]*"(?:\s*;\s*datetime="[^"]*")?')) as e, generate_subscripts(regexp_extract_all(t, '<[^>]+>\s*;\s*rel="[^"]*"(?:\s*;\s*datetime="[^"]*")?'), 1) as i from c),
m as (select id, i, regexp_replace(regexp_extract(e, '<([^>]+)>', 1), '^http:', 'https:', 'i') as url, regexp_extract(e, 'rel="([^"]*)"', 1) as rel, try_strptime(regexp_extract(e, 'datetime="\w+, ([^"]*) GMT"', 1), '%d %b %Y %H:%M:%S') as seen from e where regexp_extract(e, 'rel="([^"]*)"', 1) like '%memento%'),
b as (select id, url, row_number() over (partition by id order by (not regexp_matches(rel, '\blast\b'))::int, case when regexp_matches(rel, '\blast\b') then null else seen end desc nulls last, i) as r from m)
select c.id, b.url from c left join b on b.id = c.id and b.r = 1""")
def newest_memento(spark, sf_dir):
    return frame(spark, "id long, t string", _MAPS).select("id", u.newest_memento(u.mementos(F.col("t"))).alias("url"))


_STARTS = [("https://a.example/1", "GET"), ("https://a.example/p", "POST"), ("https://a.example/loop", "GET"), ("https://a.example/in", "GET"), ("http://127.0.0.1/", "GET")]
_HOPS = [("https://a.example/1", 301, "https://a.example/2"), ("https://a.example/2", 308, "https://a.example/3"), ("https://a.example/p", 302, "https://a.example/q"), ("https://a.example/loop", 302, "https://a.example/loop"), ("https://a.example/in", 302, "http://169.254.169.254/x"), ("https://a.example/3", 200, "https://a.example/4")]


@query(f"""with recursive {values("s", "url string, method string", _STARTS)}, {values("h", "url string, status int, target string", _HOPS)},
r as (select url, url as here, method, 0 as n, case when url like 'http://127.%' then 'private' else 'open' end as st from s
  union all select r.url, case when r.n < 5 then h.target else r.here end, case when h.status = 303 or (r.method = 'POST' and h.status in (301, 302)) then 'GET' else r.method end, r.n + 1, case when r.n >= 5 then 'too many' when h.target like 'http://169.254%' then 'private' else 'open' end
  from r join h on h.url = r.here and h.status <> 200 where r.st = 'open')
select url, here as final, least(n, 5) as hops, method, case when st = 'open' then 'ok' else st end as outcome from (select *, row_number() over (partition by url order by n desc) as k from r) where k = 1""")
def redirect_chain(spark, sf_dir):
    return readers.resolved_redirects(frame(spark, "url string, method string", _STARTS), frame(spark, "url string, status int, target string", _HOPS))


_SAFE = [(x,) for x in ("https://a.example", "http://a.example/x", "ftp://a.example", "javascript:alert(1)", "//a.example", "", "https:///x")]


@query(rf"with {values('c', 'u string', _SAFE)} select u, regexp_matches(u, '^https?://[^/?#]', 'i') as web, regexp_matches(u, '^https://[^/?#]', 'i') as sample_ok, replace(regexp_replace(u, '^http:', 'https:'), '/web/', '/web/') as secure from c")
def url_safety(spark, sf_dir):
    return frame(spark, "u string", _SAFE).select("u", u.is_web(F.col("u")).alias("web"), F.col("u").rlike("^(?i)https://[^/?#]").alias("sample_ok"), u.raw_snapshot(F.col("u")).alias("secure"))


_SNAPS = [(1, '{"archived_snapshots":{"closest":{"available":true,"url":"http://web.example.org/web/20240101000000/http://a.example/"}}}'), (2, '{"archived_snapshots":{}}'), (3, '{"archived_snapshots":{"closest":{"available":false,"url":"http://x"}}}')]


@query(rf"""with {values("c", "id long, j string", _SNAPS)} select id, case when json_extract_string(j, '$.archived_snapshots.closest.available') = 'true' then
  regexp_replace(regexp_replace(json_extract_string(j, '$.archived_snapshots.closest.url'), '^http:', 'https:'), '/web/(\d+)/', '/web/\1id_/') end as url from c""")
def snapshot_lookup(spark, sf_dir):
    rows = frame(spark, "id long, j string", _SNAPS)
    open_ = F.get_json_object("j", "$.archived_snapshots.closest.available") == "true"
    return rows.select("id", F.when(open_, u.raw_snapshot(F.get_json_object("j", "$.archived_snapshots.closest.url"))).alias("url"))


_RANGES = [(h, n) for h in (None, "", "bytes=0-99", "bytes=-100", "bytes=1000-", "bytes=5-2", "bytes=0-1,2-3", "bytes=-0", "BYTES = 10 - ", "items=0-1", "bytes=-", "bytes=990-2000") for n in (1000, 0)]


@query(rf"""with {values("c", "header string, length long", _RANGES)}, s as (select *, regexp_extract(header, '^(?i)\s*bytes\s*=\s*(.+)$', 1) as spec from c),
p as (select *, list_filter(list_transform(string_split(spec, ','), lambda z: trim(z)), lambda z: z <> '') as parts from s), o as (select *, coalesce(parts[1], '') as one from p),
f as (select *, regexp_extract(one, '^(\d*)\s*-\s*(\d*)$', 1) as a, regexp_extract(one, '^(\d*)\s*-\s*(\d*)$', 2) as b from o),
n as (select *, try_cast(a as bigint) as x, try_cast(b as bigint) as y, header is null or spec = '' or len(parts) <> 1 or not regexp_matches(one, '^(\d*)\s*-\s*(\d*)$') or (a = '' and b = '') as nothing from f),
k as (select *, case when nothing then 'none' when a = '' and (coalesce(y, 0) = 0 or length = 0) then 'unsatisfiable' when a = '' then 'range' when b <> '' and y < x then 'none' when x >= length then 'unsatisfiable' else 'range' end as type from n)
select header, length, type, case when type = 'range' then case when a = '' then greatest(0, length - y) else x end end as first, case when type = 'range' then case when a = '' or b = '' then length - 1 else least(y, length - 1) end end as last from k""")
def byte_range(spark, sf_dir):
    r = frame(spark, "header string, length long", _RANGES).withColumn("r", u.byte_range(F.col("header"), F.col("length")))
    return r.select("header", "length", "r.type", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


_BYTES = [(1, b"\x89PNG\r\n\x1a\n0000"), (2, b"\xff\xd8\xff\xe0" + b"0" * 9), (3, b"GIF89a" + b"0" * 8), (4, b"RIFF0000WEBP"), (5, b"0000ftypheic"), (6, b"0000ftypmp42"), (7, b"\x89PNG"), (8, b"  \n%PDF-1.7 x"), (9, b"x%PDF-1.7 abcdef"), (10, b"")]


@query(f"""with {values("c", "id long, b binary", _BYTES)}, h as (select id, hex(b) as h, octet_length(b) as n from c)
select id, case when n >= 12 then case when h like '89504E47%' then 'image/png' when h like 'FFD8FF%' then 'image/jpeg' when h like '47494638%' then 'image/gif' when h like '52494646%' and substr(h, 17, 8) = '57454250' then 'image/webp'
  when substr(h, 9, 8) = '66747970' and substr(h, 17, 8) in ('68656963', '68656978', '68657663', '6D696631', '6D736631', '6865696D', '68656973') then 'image/heic' end end as image,
  regexp_matches(h, '^(?:09|0A|0B|0C|0D|20)*255044462D') as pdf from h""")
def byte_sniff(spark, sf_dir):
    return frame(spark, "id long, b binary", _BYTES).select("id", u.image_type(F.col("b")).alias("image"), u.is_pdf_bytes(F.col("b")).alias("pdf"))


_CHALLENGES = [(1, 200, "<html><title> archive.ph </title>"), (2, 429, ""), (3, 200, "<title>A story</title>"), (4, 404, None), (5, 503, "x")]


@query(rf"with {values('c', 'id long, status int, html string', _CHALLENGES)} select id, status in (429, 403, 503) or regexp_matches(substr(coalesce(html, ''), 1, 4000), '(?i)<title>\s*archive\.[a-z]{{2,6}}\s*</title>') as challenge from c")
def challenge_pages(spark, sf_dir):
    return frame(spark, "id long, status int, html string", _CHALLENGES).select("id", u.is_challenge(F.col("status"), F.col("html")).alias("challenge"))


_TRIES = [("a", 0, 0, None, "timeout"), ("a", 0, 1, "https://m0/a", None), ("a", 1, 0, "https://m1/a", None), ("b", 0, 0, None, "timeout"), ("b", 1, 0, None, "challenge"), ("c", 0, 0, None, "not found"), ("c", 1, 0, None, "timeout")]


@query(f"""with {values("c", "url string, mirror int, lookup int, found string, error string", _TRIES)}
select url, found, case when found is null then error end as error from (select *, row_number() over (partition by url order by found is null, coalesce(error <> 'challenge', true), mirror, lookup) as r from c) where r = 1""")
def snapshot_pick(spark, sf_dir):
    return readers.pick_snapshot(frame(spark, "url string, mirror int, lookup int, found string, error string", _TRIES))


_LINES = [(1, "  https://a.example "), (2, "# a comment"), (3, ""), (4, "\t"), (5, "https://b.example"), (6, "https://c.example")]


@query(f"""with {values("l", "n long, value string", _LINES)}, k as (select n, trim(value, ' ' || chr(9)) as value from l where trim(value, ' ' || chr(9)) <> '' and not starts_with(trim(value, ' ' || chr(9)), '#')),
r as (select 0 as stage, n, value from k where n <> 5 union all select 1, n, 'fallback ' || value from k) select rank, value from (select row_number() over (order by stage, n) as rank, value from r) where rank <= 4""")
def demo_seed(spark, sf_dir):
    lines = readers.line_list(frame(spark, "n long, value string", _LINES))
    settled = lines.withColumn("ok", F.col("n") != 5)
    return readers.with_fallback(settled, lines.withColumn("value", F.concat(F.lit("fallback "), "value")), 4)


_REPLIES = [
    (1, "archive", '[{"canonical_url":"https://a.example/p/1","title":"One","subtitle":"s","post_date":"2024-03-04T05:06:07Z","publishedBylines":[{"name":"A B"},{"name":"C"}]},{"canonical_url":"https://a.example/p/2","title":"Two","post_date":"","publishedBylines":[]}]'),
    (1, "search", '[{"url":"https://w.example/1","title":"Plain"},{"url":"https://w.example/2","title":{"rendered":"Rendered"}}]'),
    (2, "works", '{"message":{"items":[{"title":["Paper"],"DOI":"10.1/x","container-title":["Journal"],"author":[{"given":"D","family":"E"},{"family":"F"}]}]}}'),
]


@query("""select * from (values (1, 0, 'https://a.example/p/1', 'One', 's', '2024-03-04', 'A B, C'), (1, 1, 'https://a.example/p/2', 'Two', null, null, null), (1, 0, 'https://w.example/1', 'Plain', null, null, null),
  (1, 1, 'https://w.example/2', 'Rendered', null, null, null), (2, 0, 'https://doi.org/10.1/x', 'Paper', 'Journal', null, 'D E, F')) t(candidate, n, url, title, subtitle, published, byline)""")
def found_posts(spark, sf_dir):
    return readers.found_posts(frame(spark, "candidate long, format string, body string", _REPLIES))


@query("""with f as (select page_id as id, case page_id % 4 when 0 then 'text/html' when 1 then 'application/pdf' when 2 then '' else 'image/png' end as type, octet_length(encode(html)) as n from pages)
select id, case type when 'application/pdf' then 'pdf' when 'image/png' then 'other' else 'html' end as kind, n > case when type = 'application/pdf' then 26214400 else 8388608 end as refused from f""")
def fetched_documents(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("text/html", "application/pdf", "", "image/png")))
    bodies = src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", kinds[(F.col("page_id") % 4).cast("int")].alias("type"), F.col("html").cast("binary").alias("body"))
    return readers.fetched(bodies).select("id", "kind", "refused")
