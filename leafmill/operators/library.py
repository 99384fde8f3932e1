"""The library: filtered and searched views, lists, counters, projections of saved articles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import rx

PAGE = 500
LIST_COLUMNS = ["id", "url", "title", "site_name", "excerpt", "word_count", "saved_at", "read_at", "favorite", "archived", "tags", "progress"]
TERM_BREAK = re.compile(f"[{rx.SPACE_CHARS}]+")


def view(articles: DataFrame, name: str | None, members: DataFrame | None = None) -> DataFrame:
    """unread, read, favorites (archived ones too), archived, collection:<id>, or by default all that isn't archived."""
    listed = re.fullmatch(r"collection:(\d+)", name or "")
    if listed:
        inside = members.where(F.col("collection_id") == int(listed[1])).select(F.col("article_id").alias("id"))
        return articles.where(~F.col("archived")).join(inside, "id", "left_semi")
    if name == "unread":
        return articles.where(F.col("read_at").isNull() & ~F.col("archived"))
    if name == "read":
        return articles.where(F.col("read_at").isNotNull() & ~F.col("archived"))
    if name == "favorites":
        return articles.where("favorite")
    if name == "archived":
        return articles.where("archived")
    return articles.where(~F.col("archived"))


def newest(articles: DataFrame, limit: int = PAGE) -> DataFrame:
    """The newest first; equal times by the greater id."""
    return articles.orderBy(F.desc("saved_at"), F.desc("id")).limit(limit)


def with_collections(page: DataFrame, members: DataFrame) -> DataFrame:
    """Each row with the sorted ids of its lists, an empty array for none. The lists of the page alone are nested."""
    nested = members.join(page.select(F.col("id").alias("article_id")), "article_id", "left_semi").groupBy("article_id").agg(F.sort_array(F.collect_list("collection_id")).alias("collections"))
    return page.join(nested, page["id"] == nested["article_id"], "left").drop("article_id").withColumn("collections", F.coalesce("collections", F.array().cast("array<bigint>")))


def substring_search(articles: DataFrame, q: str) -> DataFrame:
    """The browser's dialect: the whole query as one substring of title, site, byline or text, in lower case; no stemming, no limit."""
    needle = TERM_BREAK.sub(" ", q).strip().lower() if not q.strip() else q.strip().lower()
    found = F.lit(False)
    for c in ("title", "site_name", "byline", "text_content"):
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return articles.where(found) if needle else articles


def terms(q: str) -> list[str]:
    return [t for t in TERM_BREAK.split(q) if t]


def library_page(articles: DataFrame, members: DataFrame, matching: DataFrame | None = None, name: str | None = None, limit: int = PAGE) -> DataFrame:
    """The list request: view, what of it a search has found (`matching`: doc_id), newest page, lists attached. The page is chosen
    by ids and times alone; its ids, `limit` at most, then reach the scan of what the caller selects of its rows."""
    rows = view(articles, name, members).select("id", "saved_at")
    if matching is not None:
        rows = rows.join(matching.select(F.col("doc_id").alias("id")), "id", "left_semi")
    ids = [r["id"] for r in newest(rows, limit).collect()]
    return with_collections(articles.select(*LIST_COLUMNS).where(F.col("id").isin(ids)), members.where(F.col("article_id").isin(ids)))


def collection_counts(collections: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    """Every list, in its order, with how many of its articles aren't archived."""
    counted = members.join(articles.where(~F.col("archived")).select(F.col("id").alias("article_id")), "article_id").groupBy("collection_id").count()
    joined = collections.join(counted, F.col("id") == F.col("collection_id"), "left")
    return joined.select("id", "name", "position", F.coalesce("count", F.lit(0)).alias("count")).orderBy("position", "id")


def collection_names(articles: DataFrame, members: DataFrame, collections: DataFrame, separator: str = " · ") -> DataFrame:
    """Each article's list names, joined in list order."""
    named = members.join(collections, F.col("collection_id") == F.col("id")).groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("position", "id", "name"))).alias("l"))
    joined = articles.select(F.col("id").alias("article")).join(named, F.col("article") == F.col("article_id"), "left")
    return joined.select(F.col("article").alias("id"), F.coalesce(F.array_join("l.name", separator), F.lit("")).alias("lists"))


def untagged(articles: DataFrame) -> DataFrame:
    """Articles the tagging pass hasn't reached: no tags, but a text."""
    return articles.where((F.col("tags").isNull() | (F.size("tags") == 0)) & (F.coalesce("text_content", F.lit("")) != ""))


def round_half_up(x: F.Column) -> F.Column:
    """JavaScript's Math.round: halves go up."""
    return F.floor(x + 0.5)


def reading_minutes(words: F.Column, rate: int = 230) -> F.Column:
    return F.greatest(F.lit(1), round_half_up(words / rate)).cast("long")


def relative_date(at: F.Column, now: F.Column) -> F.Column:
    """today, yesterday, Nd ago under thirty days, else the date."""
    days = F.datediff(now, at)
    return F.when(days <= 0, F.lit("today")).when(days == 1, F.lit("yesterday")).when(days < 30, F.concat(days.cast("string"), F.lit("d ago"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def badge(quality: F.Column) -> F.Column:
    """What a row says of an article that isn't whole."""
    return F.when(quality == "partial", F.lit("partial")).when(quality == "link", F.lit("link")).when(quality == "stub", F.lit("stub")).otherwise(F.lit(""))


def shows_progress(progress: F.Column) -> F.Column:
    return (progress > 0.02) & (progress < 0.97)


def next_position(collections: DataFrame) -> DataFrame:
    return collections.agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("next"))


def ascii_fold(text: F.Column) -> F.Column:
    """Equality without case for ASCII letters alone, as NOCASE has it."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def name_clashes(collections: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted renames (id, new_name): the cleaned name, and whether it is empty or another list's already."""
    clean = F.substring(F.regexp_replace("new_name", rx.TRIM, ""), 1, 40)
    rows = wanted.select(F.col("id").alias("wid"), clean.alias("clean"))
    other = collections.select(F.col("id").alias("oid"), ascii_fold(F.col("name")).alias("folded")).distinct()
    hit = rows.join(other, (ascii_fold(F.col("clean")) == F.col("folded")) & (F.col("wid") != F.col("oid")), "left")
    return hit.groupBy("wid", "clean").agg(F.max(F.when(F.col("clean") == "", "empty").when(F.col("oid").isNotNull(), "taken").otherwise("ok")).alias("verdict"))


def occurrence(partition: list[str], order: list[str]) -> F.Column:
    """Which occurrence of its key a row is, from 0."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1


def script_language(text: F.Column) -> F.Column:
    """The language a text's script gives away, from its first 4000 characters; else en."""
    head = F.substring(text, 1, 4000)
    letters = F.greatest(F.regexp_count(head, F.lit(r"\p{L}")), F.lit(1))

    def share(pattern: str) -> F.Column:
        return F.regexp_count(head, F.lit(pattern)) / letters

    # fixed values: Unicode ranges of the scripts and the shares at which they decide
    return (
        F.when(share("[぀-ヿ]") > 0.05, F.lit("ja")).when(share("[가-힯]") > 0.05, F.lit("ko")).when(share("[一-鿿]") > 0.1, F.lit("zh"))
        .when(share("[Ѐ-ӿ]") > 0.2, F.lit("ru")).when(share("[؀-ۿ]") > 0.2, F.lit("ar")).otherwise(F.lit("en"))
    )


# Phrases that mark a page cut short by a paywall, in the order in which they are looked for.
PAYWALL_MARKERS = [
    "subscribe to continue", "subscribe to read", "subscription required", "to continue reading",
    "already a subscriber", "sign in to continue", "create a free account to", "this article is for subscribers",
    "unlock this article", "become a member to", "you have reached your", "you've reached your",
    "register to continue", "continue reading with", "get unlimited access",
]


def paywall_verdict(text: F.Column, words: F.Column) -> F.Column:
    """The first marker in the head of a short text, 'too short', or null for a whole article."""
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 4000))
    first = F.coalesce(*[F.when(F.contains(head, F.lit(m)), F.lit(m)) for m in PAYWALL_MARKERS])
    return F.when(first.isNotNull() & (words < 800), first).when(words < 120, F.lit("too short"))


def content_revision(*fields: F.Column) -> F.Column:
    """An identity of an article's content: the first 31 hex digits of the digest of its fields, null as empty, parted by U+001F."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(f, F.lit("")) for f in fields]), 256), 1, 31)
