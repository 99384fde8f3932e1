"""Pages to article rows: metadata, marks, main content, sanitising, rewriting, verdict, and the choice among attempts.

A page is parsed once per row, in mapInArrow; everything that needs no tree is a column expression.
"""

from __future__ import annotations

import json
import re
from itertools import batched
from urllib.parse import quote, urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import rx, urls
from leafmill.operators.dom import Node, body_of, parse, serialise
from leafmill.operators.library import PAYWALL_MARKERS
from leafmill.sources.shared import in_batches

Column = F.Column

# Elements and attributes that a stored article may hold.
ALLOWED_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figure figcaption img a em i strong b u s ul ol li pre code hr br table thead tbody tr th td caption sup sub mark cite q span div section audio video source time abbr dl dt dd".split())
ALLOWED_ATTRS = frozenset("href src srcset sizes alt title width height datetime colspan rowspan class lang dir controls type loading data-speech".split())
DROPPED_WHOLE = frozenset("script style noscript template iframe object embed svg math canvas form head title".split())
SPEECH_MARKS = ("exclude", "include")
# What a page's own markup calls captions, credits and bylines; the greatest lengths of such blocks.
CAPTION_TOKEN = re.compile(r"(?:^|[-_])(?:caption|captions|figcaption|caption-text|wp-caption-text)(?:[-_]|$)")
CREDIT_TOKEN = re.compile(r"(?:^|[-_])(?:credit|credits|photo-credit|image-credit|copyright|attribution)(?:[-_]|$)")
INFO_TOKEN = re.compile(r"(?:^|[-_])(?:byline|bylines|dateline|timestamp|pubdate|publish-date|published-date|article-meta|post-meta|entry-meta|story-meta|metadata|reading-time|read-time|readtime|author-name|authors?)(?:[-_]|$)")
PROPERTIES = {"speech-caption": {"caption"}, "speech-credit": {"copyrightholder", "credittext", "copyrightnotice"}, "speech-info": {"author", "datepublished", "datemodified", "datecreated", "creator", "publisher"}}
MARK_LENGTH = {"speech-caption": 400, "speech-credit": 200, "speech-info": 200}
ARCHIVE_CHROME = frozenset("HEADER TOOLBAR SHARE DONATE social globalhead footer banner CONTROLS".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figure figcaption li pre hr br tr td th caption div section dt dd".split())
NOT_CONTENT = frozenset("script style noscript template nav footer aside form iframe head button select textarea".split())
SAFE_LINK = re.compile(r"(?i)^(?:https?:|mailto:|tel:|#|/|[^:]*$)")


def flat(text: str) -> str:
    return " ".join(text.split())


def metadata(root: Node) -> dict[str, str | None]:
    """Lead image, canonical, AMP and og addresses, and the publishing date, first from tags, then from ld+json."""
    metas = list(root.find("meta"))

    def meta(**want: str) -> str | None:
        (key, value), = want.items()
        return next((m.attrs["content"] for m in metas if m.attrs.get(key) == value and m.attrs.get("content")), None)

    def link(rel: str) -> str | None:
        return next((n.attrs["href"] for n in root.find("link") if n.attrs.get("rel") == rel and n.attrs.get("href")), None)

    published = meta(property="article:published_time") or meta(name="article:published_time") or meta(itemprop="datePublished") or next((t.attrs["datetime"] for t in root.find("time") if t.attrs.get("datetime")), None)
    for script in [] if published else root.find("script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads(script.text())
        except ValueError:
            continue
        nodes = data if isinstance(data, list) else data.get("@graph") or [data] if isinstance(data, dict) else []
        published = next((n["datePublished"] for n in nodes if isinstance(n, dict) and n.get("datePublished")), None)
        if published:
            break
    return {
        "lead_image": meta(property="og:image") or meta(name="twitter:image"),
        "canonical": link("canonical"),
        "amp_url": link("amphtml"),
        "og_url": meta(property="og:url") or meta(name="twitter:url"),
        "published_at": str(published) if published else None,
    }


def strip_archive_chrome(root: Node, original: str | None) -> None:
    """Without the frame an archive puts around a capture; assets point at their first hosts again."""
    for n in [n for n in root.walk() if n.attrs.get("id") in ARCHIVE_CHROME]:
        n.remove()
    for n in root.walk():
        for a in ("src", "href"):
            host = (urlparse(n.attrs.get(a, "")).hostname or "").removeprefix("www.")
            if host in urls.ARCHIVE_HOSTS and (m := re.search(r"(?i)(?:^|/)(https?://.+)$", urlparse(n.attrs[a]).path)):
                n.attrs[a] = m[1]


def promote_pullquotes(root: Node) -> None:
    for n in list(root.walk()):
        names = n.attrs.get("class", "").lower()
        if not ("pullquote" in names or "pull-quote" in names or "blockquote" in names or n.tag == "aside" and "quote" in names):
            continue
        if any(u.tag == "blockquote" for u in n.up()) or any(n.find("blockquote")) or not 0 < len(n.text().strip()) <= 600:
            continue
        quote_ = Node("blockquote", {"class": "pullquote"})
        for c in n.children:
            quote_.add(c)
        n.replace(quote_)


def mark_speech(root: Node) -> None:
    """Short captions, credits and bylines get one class of ours; a page's own uses of those marks go first."""
    nodes = list(root.walk())
    for n in nodes:
        if "class" in n.attrs:
            n.attrs["class"] = " ".join(c for c in n.classes() if c not in MARK_LENGTH)
        n.attrs.pop("data-speech", None)

    def mark(n: Node, name: str | None) -> None:
        if name and len(flat(n.text())) <= MARK_LENGTH[name] and name not in n.classes():
            n.attrs["class"] = " ".join([*n.classes(), name])

    for n in nodes:
        props = set(n.attrs.get("itemprop", "").lower().split())
        mark(n, next((k for k, v in PROPERTIES.items() if props & v), None))
    for n in nodes:
        tokens = [t.lower() for t in n.classes()]
        mark(n, next((k for k, p in (("speech-caption", CAPTION_TOKEN), ("speech-credit", CREDIT_TOKEN), ("speech-info", INFO_TOKEN)) if any(p.search(t) for t in tokens)), None))


def main_content(root: Node) -> Node | None:
    """The element that holds the article: the greatest <article>, else <main>, else the block with most text not in links."""

    def weight(n: Node) -> float:
        text = linked = 0
        for p in n.walk():
            if p.tag in ("p", "li", "blockquote", "pre", "td") and not any(u.tag in NOT_CONTENT for u in p.up()):
                text += len(flat("".join(c for c in p.children if isinstance(c, str))))
            elif p.tag == "a":
                linked += len(flat(p.text()))
        return text - linked

    for tags in (("article",), ("main",)):
        if found := [n for n in root.find(*tags) if n.text().strip()]:
            return max(found, key=weight)
    blocks = [n for n in root.find("div", "section", "td", "body") if n.text().strip() and not any(u.tag in NOT_CONTENT for u in n.up())]
    if not blocks:
        return root if root.text().strip() else None
    best = max(weight(n) for n in blocks)
    return [n for n in blocks if weight(n) >= 0.8 * best][-1] if best > 0 else blocks[0]


def sanitised(node: Node) -> Node:
    """A copy with allowed elements and attributes alone; other elements give way to what is in them, unsafe ones go whole."""
    out = Node("#document")

    def copy(n: Node, to: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                to.add(c)
            elif c.tag in DROPPED_WHOLE:
                continue
            elif c.tag in ALLOWED_TAGS:
                attrs = {k: v for k, v in c.attrs.items() if k in ALLOWED_ATTRS and (k not in ("href", "src") or SAFE_LINK.match(v.strip()) or k == "src" and v.startswith("data:image/")) and (k != "data-speech" or v in SPEECH_MARKS)}
                kept = Node(c.tag, attrs)
                to.add(kept)
                copy(c, kept)
            else:
                copy(c, to)

    copy(node, out)
    return out


def largest_source(srcset: str) -> str | None:
    """The candidate of a srcset with the greatest whole descriptor, the first of equals."""
    found = [(p[0], int(m[0]) if len(p) > 1 and (m := re.match(r"\d+", p[1])) else 0) for c in srcset.split(",") if (p := c.split())]
    return max(found, key=lambda f: f[1])[0] if found else None


def rewritten(root: Node, base: str) -> Node:
    """Images through the proxy, lazily; links absolute; blocks without text or media gone."""
    for n in list(root.find("img")):
        src = n.attrs.get("src", "")
        if (not src or src.startswith("data:")) and n.attrs.get("srcset"):
            src = largest_source(n.attrs["srcset"]) or src
        if not src or src.startswith("data:"):
            n.remove()
            continue
        for a in ("srcset", "sizes"):
            n.attrs.pop(a, None)
        n.attrs |= {"src": "/api/image?url=" + quote(urljoin(base, src), safe="-_.!~*'()"), "loading": "lazy"}
    for n in root.find("a"):
        if "href" in n.attrs:
            n.attrs |= {"href": urljoin(base, n.attrs["href"]), "target": "_blank", "rel": "noopener"}
    for n in list(root.find("p", "div", "section", "span")):
        if n.parent and not n.text().strip() and not any(n.find("img", "video", "audio", "iframe", "hr")):
            n.remove()
    return root


def text_of(root: Node) -> str:
    """The text, where the end of a block is the end of a word."""
    out: list[str] = []

    def visit(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            else:
                visit(c)
                if c.tag in BREAKS:
                    out.append(" ")

    visit(root)
    return flat("".join(out))


def verdict(text: str, words: int) -> str | None:
    head = text[:4000].lower()
    marker = next((m for m in PAYWALL_MARKERS if m in head), None)
    return marker if marker and words < 800 else "too short" if words < 120 else None


ARTICLE = "url string, ok boolean, reason string, title string, site_name string, excerpt string, content_html string, text_content string, word_count long, lead_image string, published_at string, canonical_url string, amp_url string, og_url string"


def attempt(source: str, url: str, archived: bool = False) -> dict:
    """The article row of a page, with whether it is whole and if not why."""
    root = parse(source)
    if archived:
        strip_archive_chrome(root, url)
    meta = metadata(root)
    promote_pullquotes(root)
    mark_speech(root)
    title = next((flat(t.text()) for t in root.find("title") if flat(t.text())), None)
    main = main_content(root)
    nothing = dict.fromkeys((f.split()[0] for f in ARTICLE.split(", ")), None) | {"url": url, "ok": False, "amp_url": meta["amp_url"], "og_url": meta["og_url"]}
    if main is None:
        return nothing | {"reason": "found no article"}
    for n in [n for n in main.walk() if n.tag in NOT_CONTENT]:
        n.remove()
    clean = rewritten(sanitised(main), url)
    text = text_of(clean)
    words = len(text.split())
    why = verdict(text, words)
    return nothing | {
        "ok": why is None, "reason": why, "title": title or url, "site_name": (urlparse(url).hostname or "").removeprefix("www."), "excerpt": text[:300].strip(),
        "content_html": serialise(clean), "text_content": text, "word_count": words, "lead_image": meta["lead_image"], "published_at": meta["published_at"], "canonical_url": meta["canonical"] or url,
    }


def article_rows(pages: DataFrame) -> DataFrame:
    """Article rows of pages (url, html); null html is an empty page."""
    names = [f.split()[0] for f in ARTICLE.split(", ")]
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}

    def each(batches):
        for batch in batches:
            # a page is text in Python only while it is read, and what is made of pages is handed over by the hundred
            for rows in batched((attempt(h.as_py() or "", u.as_py() or "") for u, h in zip(batch.column("url"), batch.column("html"), strict=True)), 100):
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[f.split()[1]]) for n, f in zip(names, ARTICLE.split(", "), strict=True)], names)

    return in_batches(pages.select("url", "html"), each, ARTICLE)


def trimmed(content: str, marked: set[int]) -> str:
    """An article without the marked elements (numbers in document order) and the blocks they leave empty."""
    root = parse(content)
    nodes = list(root.walk())
    for i in marked:
        if i < len(nodes):
            nodes[i].remove()
    for n in list(root.find("p", "div", "section", "li", "blockquote", "figure")):
        if not n.text().strip() and not any(n.find("img", "video", "audio", "hr")):
            n.remove()
    return serialise(body_of(root))


def drop_cap(content: str | None) -> int | None:
    """Which paragraph opens with a drop cap: the first of more than 120 characters outside quotes and figures, without a
    picture or a leading emphasis, that doesn't open with a quotation mark."""
    for i, p in enumerate(parse(content or "").find("p")):
        text = p.text().strip()
        first = next(iter(p.elements()), None)
        if len(text) > 120 and text[0] not in "\"“”" and not any(u.tag in ("blockquote", "figure", "figcaption") for u in p.up()) and not any(p.find("img")) and not (first and first.tag == "em"):
            return i
    return None


# ── expressions ──


def html_text(html: Column) -> Column:
    """The text of markup without a tree: scripts, styles and comments out, tags to spaces, common references decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    # fixed values: the references that are decoded, & last
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(ch))
    return F.regexp_replace(F.regexp_replace(x, rx.SPACES, " "), "^ | $", "")


def words_of(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("long")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def looks_like_html(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, 4000).rlike(r"(?is)</?[a-z].*>")


def plain_text_html(text: Column) -> Column:
    """Copied text as a page: the first line that isn't blank is the heading, each other one a paragraph."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, rx.TRIM, "")), lambda x: x != "")

    def page(kept: Column) -> Column:
        heading = escaped(F.get(kept, 0))
        body = F.array_join(F.transform(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))), "")
        return F.when(F.size(kept) > 0, F.concat(F.lit("<html><head><title>"), heading, F.lit("</title></head><body><article><h1>"), heading, F.lit("</h1>"), body, F.lit("</article></body></html>"))).otherwise(F.lit(""))

    return F.get(F.transform(F.array(lines), page), 0)  # the lines are made once and used by name


def title_fallback(html: Column, url: Column) -> Column:
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), rx.SPACES, " "))
    return F.when(title == "", url).otherwise(title)


def head_meta(html: Column) -> Column:
    """struct(canonical, og_url, lead_image, published_at) by patterns over the head, for pages that need no tree."""

    def tag(attr: str, name: str, value: str = "content") -> Column:
        one = F.regexp_extract(html, rf'(?is)<(?:meta|link)\b[^>]*\b{attr}="{name}"[^>]*\b{value}="([^"]*)"', 1)
        other = F.regexp_extract(html, rf'(?is)<(?:meta|link)\b[^>]*\b{value}="([^"]*)"[^>]*\b{attr}="{name}"', 1)
        return F.coalesce(F.nullif(one, F.lit("")), F.nullif(other, F.lit("")))

    ld = F.regexp_extract(html, r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    dated = F.coalesce(F.get_json_object(ld, "$.datePublished"), F.get_json_object(ld, "$[0].datePublished"), F.get_json_object(ld, "$['@graph'][0].datePublished"))
    return F.struct(tag("rel", "canonical", "href").alias("canonical"), tag("property", "og:url").alias("og_url"), tag("property", "og:image").alias("lead_image"), F.coalesce(tag("property", "article:published_time"), dated).alias("published_at"))


def captured_origin(embedded: Column, og_url: Column, canonical: Column) -> Column:
    return F.coalesce(embedded, F.when(urls.is_web(og_url), og_url), F.when(urls.is_web(canonical), canonical))


def link_stub(url: Column, title: Column, byline: Column, note: Column, excerpt: Column) -> Column:
    """An article that couldn't be read, kept as a link with what is known of it."""
    site = urls.host_label(url)
    name = F.coalesce(title, site, url)
    return F.struct(
        name.alias("title"), site.alias("site_name"), F.substring(F.coalesce(excerpt, F.concat(F.lit("saved as a link — "), site)), 1, 300).alias("excerpt"),
        F.concat_ws(". ", name, byline, site, excerpt).alias("text_content"), F.lit(0).cast("long").alias("word_count"), F.lit("link").alias("quality"),
        F.coalesce(note, F.lit("saved as a link; the page could not be read")).alias("quality_note"),
    )


def worthwhile(attempts: DataFrame) -> DataFrame:
    """Without the strategies that only serve markup, for addresses of PDFs."""
    return attempts.where(~(urls.is_pdf(F.col("url")) & F.col("strategy").isin("amp", "archive")))


def best_attempt(attempts: DataFrame, *ties: str) -> DataFrame:
    """Of attempts (url, ord, strategy, ok, word_count, reason) the first whole one, else the longest, the earlier of equals;
    with the reasons of those that failed, in order. `ties` are columns that order a url's attempts with equal `ord`."""
    order = Window.partitionBy("url").orderBy(F.desc("ok"), F.when(F.col("ok"), F.lit(0)).otherwise(-F.col("word_count")), "ord", *ties)
    reasons = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("ord", *ties, "strategy", "reason"))).over(Window.partitionBy("url"))), lambda r: F.concat(r["strategy"], F.lit(": "), r["reason"])), "; ")
    return attempts.withColumn("reasons", reasons).withColumn("r", F.row_number().over(order)).where("r = 1").select("url", "strategy", "ok", "word_count", F.when(F.col("ok"), F.lit("")).otherwise(F.col("reasons")).alias("reasons"))


def pdf_notes(ok: Column, pages: Column, truncated: Column, unread: Column) -> Column:
    """What a row says of a PDF that was read in part."""
    a = F.when(truncated, F.concat(F.lit("only part of this "), pages.cast("string"), F.lit("-page PDF was read")))
    b = F.when(unread > 0, F.concat(unread.cast("string"), F.lit(" scanned page(s) went unread")))
    return F.nullif(F.concat_ws("; ", a, b), F.lit(""))
