"""Sources beside the library's own tables: fetched documents, archive replies, line lists, JSON pages, redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import rx, urls

PAGE_BYTES = 8 * 1024 * 1024
PDF_BYTES = 25 * 1024 * 1024


def fetched_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as fetched documents: kind by bytes first, then by name; `refused` where a body is over its cap."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return fetched(files.select(F.col("path").alias("url"), F.lit("").alias("type"), F.col("content").alias("body")))


def fetched(bodies: DataFrame) -> DataFrame:
    """(url, type, body) with kind (pdf, html, other) and whether the body is over the cap of its kind."""
    pdf = F.contains(F.lower("type"), F.lit("pdf")) | urls.is_pdf_bytes(F.col("body"))
    kind = F.when(pdf, "pdf").when((F.col("type") == "") | F.contains(F.lower("type"), F.lit("html")) | F.contains(F.lower("type"), F.lit("xml")) | F.contains(F.lower("type"), F.lit("text/")), "html").otherwise("other")
    size = F.octet_length("body")
    return bodies.withColumn("kind", kind).withColumn("refused", F.when(pdf, size > PDF_BYTES).otherwise(size > PAGE_BYTES))


def line_list(lines: DataFrame) -> DataFrame:
    """Lines (n, value), trimmed, without blank ones and # comments."""
    value = F.regexp_replace("value", rx.TRIM, "")
    return lines.select("n", value.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def with_fallback(results: DataFrame, fallback: DataFrame, wanted: int) -> DataFrame:
    """Settled results (n, ok, value): the failed ones dropped, the fallback rows appended, max(3, wanted) at most."""
    order = F.row_number().over(Window.orderBy("stage", "n"))  # a handful of seeds
    rows = results.where("ok").select(F.lit(0).alias("stage"), "n", "value").unionByName(fallback.select(F.lit(1).alias("stage"), "n", "value"))
    return rows.withColumn("rank", order).where(F.col("rank") <= max(3, wanted)).select("rank", "value")


VOICE = "id: string, title: string, description: string, tags: array<string>, languages: array<string>, popularity: bigint, state: string, visibility: string, sample: string, taken_down: boolean"


def catalogue_pages(spark: SparkSession, path: str, rows_a_page: int = 60) -> DataFrame:
    """Voice pages, one JSON object (page, items) a line; exploded in page order, at most `rows_a_page` of each."""
    pages = spark.read.schema(f"page bigint, items array<struct<{VOICE}>>").json(path)
    return pages.select("page", F.posexplode("items").alias("pos", "v")).where(F.col("pos") < rows_a_page).select("page", "pos", "v.*")


def ndjson_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of events, one JSON object a line; malformed lines read as nulls."""
    return spark.readStream.schema(schema).json(path)


def write_ndjson(events: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out."""
    events.write.mode("append").json(path)


ARCHIVE_POST = "array<struct<canonical_url: string, title: string, subtitle: string, post_date: string, publishedBylines: array<struct<name: string>>>>"
SEARCH_HIT = "array<struct<url: string, title: string>>"
WORKS = "struct<message: struct<items: array<struct<title: array<string>, DOI: string, URL: string, `container-title`: array<string>, author: array<struct<given: string, family: string>>>>>>"


def found_posts(replies: DataFrame) -> DataFrame:
    """Replies (candidate, format, body) of three kinds of index as one candidate row (url, title, subtitle, published, byline)."""

    def named(names: F.Column) -> F.Column:
        return F.nullif(F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), ", "), F.lit(""))

    archive = replies.where("format = 'archive'").select("candidate", F.posexplode(F.from_json("body", ARCHIVE_POST)).alias("n", "p")).select(
        "candidate", "n", F.col("p.canonical_url").alias("url"), F.col("p.title").alias("title"), F.col("p.subtitle").alias("subtitle"),
        F.nullif(F.substring("p.post_date", 1, 10), F.lit("")).alias("published"), named(F.col("p.publishedBylines.name")).alias("byline"),
    )
    hits = replies.where("format = 'search'").select("candidate", F.posexplode(F.from_json("body", SEARCH_HIT)).alias("n", "p"))
    plain = F.coalesce(F.get_json_object("p.title", "$.rendered"), F.col("p.title"))
    search = hits.select("candidate", "n", F.col("p.url").alias("url"), plain.alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("subtitle", "published", "byline")])
    works = replies.where("format = 'works'").select("candidate", F.posexplode(F.from_json("body", WORKS)["message"]["items"]).alias("n", "p"))
    people = F.transform("p.author", lambda a: F.concat_ws(" ", a["given"], a["family"]))
    papers = works.select(
        "candidate", "n", F.coalesce("p.URL", F.concat(F.lit("https://doi.org/"), "p.DOI")).alias("url"), F.try_element_at("p.title", F.lit(1)).alias("title"),
        F.try_element_at("p.container-title", F.lit(1)).alias("subtitle"), F.lit(None).cast("string").alias("published"), named(people).alias("byline"),
    )
    return archive.unionByName(search).unionByName(papers)


def resolved_redirects(starts: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """Follows (url -> status, target) for `most` hops; every address on the way is checked.

    starts: url, method. Returns url, final, hops, method, outcome: ok, private, or too many. 303 and a POST's 301 and 302
    become GET. A join a hop; the number of hops is fixed, the chains need no loop over rows.
    """

    def bad(u: F.Column) -> F.Column:
        return urls.is_private(urls.host(u)) & urls.host(u).rlike(r"^[0-9.]+$|:|^localhost$")

    at = starts.select("url", F.col("url").alias("at"), F.col("method").alias("how"), F.lit(0).alias("n"), F.when(bad(F.col("url")), "private").otherwise("open").alias("state"))
    step = hops.where(F.col("status").isin(301, 302, 303, 307, 308)).select(F.col("url").alias("_from"), F.col("status").alias("_s"), F.col("target").alias("_to"))
    for _ in range(most + 1):
        j = at.join(step, (F.col("at") == F.col("_from")) & (F.col("state") == "open"), "left")
        moved = F.col("_to").isNotNull()
        how = F.when((F.col("_s") == 303) | ((F.col("how") == "POST") & F.col("_s").isin(301, 302)), "GET").otherwise(F.col("how"))
        state = F.when(moved & (F.col("n") >= most), "too many").when(moved & bad(F.col("_to")), "private").when(moved, "open").when(F.col("state") == "open", "ok").otherwise(F.col("state"))
        go = moved & (F.col("n") < most)
        at = j.select("url", F.when(go, F.col("_to")).otherwise(F.col("at")).alias("at"), F.when(go, how).otherwise(F.col("how")).alias("how"), F.when(go, F.col("n") + 1).otherwise(F.col("n")).alias("n"), state.alias("state"))
    return at.select("url", F.col("at").alias("final"), F.col("n").cast("long").alias("hops"), F.col("how").alias("method"), F.when(F.col("state") == "open", "ok").otherwise(F.col("state")).alias("outcome"))


def pick_snapshot(tries: DataFrame) -> DataFrame:
    """Lookups (url, mirror, lookup, found, error) tried in order: the first found, else the error to report; a challenge
    outranks other errors, among equals the first."""
    ok = F.row_number().over(Window.partitionBy("url").orderBy(F.col("found").isNull(), F.coalesce(F.col("error") != "challenge", F.lit(True)), "mirror", "lookup"))
    return tries.withColumn("r", ok).where("r = 1").select("url", "found", F.when(F.col("found").isNull(), F.col("error")).alias("error"))
