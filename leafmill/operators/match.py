"""Loosely described references: cleaning what was read, finding candidates, and scoring the evidence for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import rx, urls
from leafmill.functions.folding import folded, words
from leafmill.functions.rx import EDGE_LEFT, EDGE_RIGHT
from leafmill.operators.similarity import dice, similar

Column = F.Column
ACCEPT = 0.72
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

# Whole lines of a screen that are furniture, and what a domain looks like.
CHROME = (
    r"(?i)^(?:find related content|search|share|subscribe|listen|repost to followers|more|membership|following|for you)$|^(?i)(?:add comment|playlist)|(?i)^effect(?![A-Za-z0-9_])"
    r"|^\d+\s*/\s*\d+$|(?i)^[\d.,]+[km]?$|(?i)^\d{1,2}:\d{2}(?:\s*[ap]m)?$|^[·•|—–\-\s]*$"
)
DOMAIN = r"(?i)(?<![A-Za-z0-9_])((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.){1,4}(?:com|org|net|io|co|dev|news|blog|xyz|me|uk|au|ca|de|fr|nl|substack\.com))(?![A-Za-z0-9_])"


def clean_text(value: Column) -> Column:
    """One-spaced, without words for nothing, 400 characters at most; null for nothing."""
    text = F.regexp_replace(F.regexp_replace(value, rx.SPACES, " "), "^ | $", "")
    return F.when((text != "") & ~text.rlike("(?i)^(null|undefined|unknown|n/a|none)$"), F.substring(text, 1, 400))


def clean_title(value: Column) -> Column:
    """Without the ellipsis, the app's verb and the quotes around; null under three characters."""
    text = F.regexp_replace(clean_text(value), r"(?i)\s*(?:\.{3}|…)\s*(?:more)?\s*$", "")
    text = F.regexp_replace(text, r"(?i)\s+(?:share|subscribe|listen|read more)\s*$", "")
    text = F.trim(F.regexp_replace(text, "^[\"“”'‘’\\s]+|[\"“”'‘’\\s]+$", ""))
    return F.when(F.length(text) >= 3, F.substring(text, 1, 300))


def first_url(value: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(value, EDGE_LEFT + r"(?i)(https?://[^\s\"'<>()]+)", 1), r"[.,;:)\]]+$", "")
    return F.when(urls.is_web(found), found)


def clean_domain(value: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "^https?://", ""), "/.*$", "")
    return F.when(text.rlike(DOMAIN), F.regexp_replace(text, r"^www\.", ""))


def first_domain(value: Column) -> Column:
    found = F.regexp_extract(value, DOMAIN, 1)
    return F.when(found != "", clean_domain(found))


def iso_date(y: Column, m: Column, d: Column) -> Column:
    """A day as text where its parts are in range; months aren't asked for their lengths."""
    yi, mi, di = y.try_cast("int"), m.try_cast("int"), d.try_cast("int")
    fine = yi.between(1900, 2200) & mi.between(1, 12) & di.between(1, 31)
    return F.when(fine, F.concat_ws("-", yi.cast("string"), F.lpad(mi.cast("string"), 2, "0"), F.lpad(di.cast("string"), 2, "0")))


def loose_date(value: Column) -> Column:
    """2025-6-23, 9 APR 2025, February 18, 2025; the first form that is there decides."""
    names = "|".join(MONTHS)
    iso = EDGE_LEFT + r"(\d{4})-(\d{1,2})-(\d{1,2})" + EDGE_RIGHT
    day_first = EDGE_LEFT + rf"(?i)(\d{{1,2}})\s+({names})[a-z]*\.?\s+(\d{{4}})" + EDGE_RIGHT
    name_first = EDGE_LEFT + rf"(?i)({names})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})" + EDGE_RIGHT

    def g(p: str, n: int) -> Column:
        return F.regexp_extract(value, p, n)

    def month(name: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("string")

    return (
        F.when(value.rlike(iso), iso_date(g(iso, 1), g(iso, 2), g(iso, 3))).when(value.rlike(day_first), iso_date(g(day_first, 3), month(g(day_first, 2)), g(day_first, 1)))
        .when(value.rlike(name_first), iso_date(g(name_first, 3), month(g(name_first, 1)), g(name_first, 2)))
    )


def is_chrome(text: Column) -> Column:
    line = F.regexp_replace(F.coalesce(text, F.lit("")), rx.TRIM, "")
    return (F.length(line) < 2) | line.rlike(CHROME)


def redacted(text: Column) -> Column:
    """Log text without keys in queries and bearer tokens."""
    out = F.regexp_replace(text, r"(?i)([?&](?:key|api[-_]?key|access[-_]?token|token)=)[^&\s\"']+", "$1[redacted]")
    return F.regexp_replace(out, EDGE_LEFT + r"(sk-|pk-|Bearer\s+)[A-Za-z0-9._-]{12,}", "$1[redacted]")


def days_apart(one: Column, other: Column) -> Column:
    return F.abs(F.datediff(one.try_cast("date"), other.try_cast("date")))


def match_detail(title: Column, days: Column, byline: Column, deck: Column) -> Column:
    """struct(score, signals) from similarities and the days between: the title carries it, the others settle ties."""
    dated = F.when(days.isNull(), 0.0).when(days <= 1, 0.12).when(days <= 30, 0.0).otherwise(-0.45)
    by, sub = F.coalesce(byline > 0.6, F.lit(False)), F.coalesce(deck > 0.6, F.lit(False))
    score = title + dated + F.when(by, 0.08).otherwise(0.0) + F.when(sub, 0.05).otherwise(0.0)
    signals = F.array_compact(F.array(F.when(title > 0.92, F.lit("title")), F.when(days <= 1, F.lit("date")), F.when(by, F.lit("byline")), F.when(sub, F.lit("deck"))))
    low = title < 0.45
    return F.struct(F.when(low, title).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).alias("score"), F.when(low, F.array().cast("array<string>")).otherwise(signals).alias("signals"))


def is_certain(url: Column, via: Column, score: Column, signals: Column, read_domain: Column) -> Column:
    return F.when(url.isNull(), F.lit(False)).when(via == "in the picture", F.lit(True)).otherwise(
        F.coalesce(F.array_contains(signals, "title") & (score >= 0.95) & ((F.size(F.array_distinct(signals)) >= 2) | read_domain), F.lit(False))
    )


#: below this a title's similarity is the whole score, and the most that date, byline and deck add to it
TITLE_LEAST, ADDED_MOST = 0.45, 0.25


def scored(candidates: DataFrame, posts: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """All pairs of candidates (candidate, title, published, byline, subtitle) and posts (post, line, the same) that could be
    accepted: their titles are compared by a similarity join at what the rest of the evidence leaves of the bound."""
    least = max(TITLE_LEAST, accept - ADDED_MOST)
    c = candidates.select("candidate", "title", *[F.col(x).alias(f"c_{x}") for x in ("published", "byline", "subtitle")])
    p = posts.select("post", "line", "title", *[F.col(x).alias(f"p_{x}") for x in ("published", "byline", "subtitle")])

    def sim(x: str) -> Column:
        return dice(words(F.col(f"c_{x}")), words(F.col(f"p_{x}")))

    detail = match_detail(F.col("dice"), days_apart(F.col("c_published"), F.col("p_published")), sim("byline"), sim("subtitle"))
    return similar(c, p, least).withColumn("m", detail).select("candidate", "post", "line", F.col("m.score").alias("score"), F.col("m.signals").alias("signals"))


def best_matches(scores: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The best post of each candidate, the smaller of equals, and whether it is good enough."""
    best = scores.groupBy("candidate").agg(F.min(F.struct((-F.col("score")).alias("less"), "post", "line", "signals")).alias("b"))
    return best.select("candidate", "b.post", "b.line", (-F.col("b.less")).alias("score"), "b.signals").withColumn("accepted", F.col("score") >= accept)


def handle_guesses(name: Column) -> Column:
    """How an address may spell a name: run together, and without a leading 'the'."""
    slug = F.regexp_replace(folded(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")
    bare = F.regexp_replace(slug, "^the", "")
    fits = F.length(slug).between(3, 40)
    return F.when(fits & (bare != slug) & (F.length(bare) >= 3), F.array(slug, bare)).when(fits, F.array(slug)).otherwise(F.array().cast("array<string>"))


def hosts_to_try(domain: Column, publication: Column, byline: Column, poster: Column, most: int = 6) -> Column:
    """Hosts worth asking, in order, each once: the domain that was read, newsletters by name, then sites by name."""
    letters = F.flatten(F.array(*[F.transform(handle_guesses(n), lambda h: F.concat(h, F.lit(".substack.com"))) for n in (publication, byline, poster)]))
    sites = F.flatten(F.transform(handle_guesses(publication), lambda h: F.array(F.concat(h, F.lit(".com")), F.concat(F.lit("www."), h, F.lit(".com")))))
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(domain), letters, sites))), 1, most)


PROFILE = "primaryPublication struct<custom_domain:string,subdomain:string>, publicationUsers array<struct<publication:struct<custom_domain:string,subdomain:string>>>"


def publication_hosts(profile: Column) -> Column:
    """Every valid host of the publications in a profile's JSON, each once."""
    p = F.from_json(profile, PROFILE)
    pubs = F.concat(F.array(p["primaryPublication"]), F.coalesce(F.transform(p["publicationUsers"], lambda u: u["publication"]), F.array().cast("array<struct<custom_domain:string,subdomain:string>>")))
    raw = F.transform(pubs, lambda x: F.coalesce(F.nullif(x["custom_domain"], F.lit("")), F.concat(x["subdomain"], F.lit(".substack.com"))))
    plain = F.transform(F.array_compact(raw), lambda h: F.lower(F.regexp_replace(F.regexp_replace(h, "^https?://", ""), "[/?#].*$", "")))
    return F.array_distinct(F.filter(plain, urls.valid_host))


def search_terms(title: Column, subtitle: Column) -> Column:
    return F.when(F.size(F.split(title, rx.SPACES)) >= 4, title).otherwise(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(subtitle, F.lit(""))))


def looks_academic(kind: Column, publication: Column, subtitle: Column, excerpt: Column) -> Column:
    text = F.concat_ws(" ", publication, subtitle, excerpt)
    # fixed values: words of papers
    pattern = r"(?i)(?<![A-Za-z0-9_])(?:university|journal of|proceedings|vol\.?\s*\d|doi|et al|department of)(?![A-Za-z0-9_])"
    return F.when(kind == "paper", F.lit(True)).when(kind == "newsletter", F.lit(False)).otherwise(text.rlike(pattern))


def candidate(raw: DataFrame) -> DataFrame:
    """Raw readings (id, title, url, subtitle, publication, byline, published, domain, kind, confidence) as candidates."""
    url = first_url(F.col("url"))
    said = F.col("confidence").try_cast("double")
    confidence = F.when(said.isNull() | F.isnan(said), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), said)))
    kind = F.when(F.col("kind").isin("article", "newsletter", "paper"), F.col("kind")).otherwise("unknown")
    rows = raw.select(
        "id", clean_title(F.col("title")).alias("title"), clean_text(F.col("subtitle")).alias("subtitle"), clean_text(F.col("publication")).alias("publication"), clean_text(F.col("byline")).alias("byline"),
        loose_date(F.col("published")).alias("published"), url.alias("url"), F.coalesce(clean_domain(F.col("domain")), urls.host_label(url)).alias("domain"), kind.alias("kind"), confidence.alias("confidence"),
    )
    return rows.where(F.col("title").isNotNull() | F.col("url").isNotNull())


def deduped(candidates: DataFrame, group: str = "screen", most: int = 6) -> DataFrame:
    """The surest reading of each title and publication, the surest `most` of a screen; ties by the order of reading."""
    key = F.trim(F.lower(F.concat(F.coalesce("title", "url"), F.lit("|"), F.coalesce("publication", F.lit("")))))
    first = F.row_number().over(Window.partitionBy(group, "_key").orderBy(F.desc("confidence"), "id"))
    kept = candidates.withColumn("_key", key).withColumn("_r", first).where("_r = 1").drop("_r", "_key")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("confidence"), "id"))).where(F.col("rank") <= most)


def headlines(lines: DataFrame) -> DataFrame:
    """screen, headline: of lines (screen, text, y, height) the first group of those set nearly as large as the largest."""
    w = Window.partitionBy("screen")
    big = lines.withColumn("_t", F.max("height").over(w)).where(F.col("height") >= F.col("_t") * 0.8)
    order = w.orderBy("y", "text")
    prev_y, prev_h = F.lag("y").over(order), F.lag("height").over(order)
    broken = (F.col("y") - (prev_y + prev_h) > prev_h * 1.2).cast("int")
    grouped = big.withColumn("_b", F.coalesce(broken, F.lit(0))).withColumn("_g", F.sum("_b").over(order)).where("_g = 0")
    return grouped.groupBy("screen").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "text"))), lambda r: r["text"]), " ").alias("headline"))


def interpreted(lines: DataFrame) -> DataFrame:
    """A candidate from each screen's lines: first address, domain and date among those that aren't furniture, the headline."""
    content = lines.where(F.col("text").isNotNull() & ~is_chrome(F.col("text")))

    def first(found: Column) -> Column:
        return F.min_by(found, F.when(found.isNotNull(), F.struct("y", "text")))

    fields = content.groupBy("screen").agg(first(first_url(F.col("text"))).alias("url"), first(first_domain(F.col("text"))).alias("read_domain"), first(loose_date(F.col("text"))).alias("published"))
    rows = fields.join(headlines(content), "screen", "left").withColumn("title", clean_title(F.col("headline")))
    out = rows.select("screen", "title", "url", "published", F.coalesce("read_domain", urls.host_label(F.col("url"))).alias("domain"), F.when(F.col("url").isNotNull(), 0.5).otherwise(0.3).alias("confidence"))
    return out.where(F.col("title").isNotNull() | F.col("url").isNotNull())


def staged(attempts: DataFrame, accept: float = ACCEPT, most: int = 12) -> DataFrame:
    """What was asked of attempts (candidate, stage, ord, host, score) when asking stops once an answer is good enough: each
    valid host once, in order, `most` in all; then the best answer of each candidate."""
    valid = attempts.where(urls.valid_host(F.col("host")))
    w = Window.partitionBy("candidate").orderBy("stage", "ord")
    once = valid.withColumn("_f", F.row_number().over(Window.partitionBy("candidate", "host").orderBy("stage", "ord"))).where("_f = 1")
    numbered = once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    good = F.min(F.when(F.col("score") >= accept, F.col("n"))).over(Window.partitionBy("candidate"))
    asked = numbered.withColumn("_g", good).where(F.col("_g").isNull() | (F.col("n") <= F.col("_g")))
    best = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc_nulls_last("score"), "n"))
    top = asked.withColumn("asked", F.count(F.lit(1)).over(Window.partitionBy("candidate"))).withColumn("_r", best).where("_r = 1")
    return top.select("candidate", F.col("asked").cast("long").alias("asked"), F.when(F.col("score") >= accept, F.col("host")).alias("host"), F.coalesce("score", F.lit(0.0)).alias("score"))


def resolve_order(resolved: DataFrame, group: str = "screen", most: int = 4) -> DataFrame:
    """The surest `most` candidates of a screen, found ones first, then by score times confidence."""
    worth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("confidence"), "id"))
    shown = F.row_number().over(Window.partitionBy(group).orderBy(F.col("url").isNull(), F.desc(F.col("score") * F.col("confidence")), "worth"))
    return resolved.withColumn("worth", worth).where(F.col("worth") <= most).withColumn("rank", shown)
