"""Queries over what sources give: documents by address, numbered pages, lines of JSON. What they read is written from the tables first."""

from pyspark.sql import functions as F

from leafmill.plans.base import query
from leafmill.sources import adapters as src
from leafmill.sources import paged, readers
from leafmill.sources.shared import fresh_dir
from leafmill.streaming import state as s


def _address(spark, label):
    """A fresh folder of the shared one, as the address that pages are fetched from."""
    folder = fresh_dir(spark, label)
    return folder if folder.startswith("file:") else f"file://{folder}"


def _put(pages, path):
    paged.register(pages.sparkSession)
    pages.write.format("leafmill_pages").mode("append").option("path", path).save()


@query("""select page_id as id, 'html' as kind, octet_length(encode(html)) > 8388608 as refused, true as ok, octet_length(encode(html))::bigint as n_bytes, null::varchar as error from pages
union all select -1, null, null, false, null, 'missing'
union all select -2, null, null, false, null, 'refused'""")
def fetched_pages(spark, sf_dir):
    """Every page's document asked for by its address, beside one that is missing and one that isn't asked for; kinds by first bytes."""
    path = _address(spark, "documents")
    pages = src.table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.col("html").cast("binary").alias("body"))
    _put(pages, path)
    number = F.regexp_extract("url", r"page-(-?\d+)\.json$", 1).cast("long")
    kinds = readers.fetched_files(spark, path, "page-*.json").select(number.alias("id"), "kind", "refused")
    wanted = pages.select(F.concat(F.lit(f"{path}/page-"), F.col("page").cast("string"), F.lit(".json")).alias("url"))
    wanted = wanted.unionByName(spark.createDataFrame([(f"{path}/page--1.json",), ("ftp://elsewhere/page--2.json",)], "url string"))
    got = paged.fetched_urls(wanted).select(number.alias("id"), "ok", F.octet_length("body").cast("long").alias("n_bytes"), "error")
    return got.join(kinds, "id", "left").select("id", "kind", "refused", "ok", "n_bytes", "error")


ROWS = 60
_ITEM = "struct<id: bigint, title: string, tags: array<string>>"
_CATALOGUE = f"""with p as (select p_partkey // {ROWS} as page, p_partkey % {ROWS} as pos, p_partkey as id, p_name as title, p_type as tag from part)"""


def _catalogue(spark, sf_dir, failed=None):
    """The parts as a catalogue's pages of 60; a page that failed has no body."""
    p = src.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / ROWS).alias("page"), F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_type").alias("tags")).alias("item"))
    pages = p.groupBy("page").agg(F.to_json(F.struct(F.sort_array(F.collect_list("item")).alias("items"))).cast("binary").alias("body"))
    return pages.withColumn("body", F.when(F.col("page") == failed, F.lit(None)).otherwise(F.col("body"))) if failed is not None else pages


def _items(settled):
    """Items of the pages that came, at most 60 of each; a page that didn't is a row that says why."""
    items = F.from_json(F.col("body").cast("string"), f"struct<items: array<{_ITEM}>>")["items"]
    rows = settled.select("page", "error", F.posexplode_outer(F.slice(items, 1, ROWS)).alias("pos", "v"))
    return rows.select("page", F.col("pos").cast("long").alias("pos"), "v.id", "v.title", F.get("v.tags", F.lit(0)).alias("tag"), "error")


@query(f"{_CATALOGUE} select page, pos, id, title, tag, null::varchar as error from p where page <> 1 union all select distinct page, null::bigint, null::bigint, null, null, 'missing' from p where page = 1")
def paged_catalogue(spark, sf_dir):
    """A catalogue in numbered pages of which one fails: the others come, and it is a row."""
    path = _address(spark, "catalogue")
    _put(_catalogue(spark, sf_dir, failed=1), path)
    return _items(spark.read.format("leafmill_pages").option("path", path).load())


@query(f"{_CATALOGUE} select page, pos, id, title, tag from p")
def stream_paged_catalogue(spark, sf_dir):
    """The catalogue as a stream that goes on where it stopped when more pages are there, through lines of JSON and back."""
    path = _address(spark, "growing")
    pages, lines = _catalogue(spark, sf_dir), f"{path}/lines"

    def drain():
        stream = _items(spark.readStream.format("leafmill_pages").option("path", path).load()).drop("error")
        stream.writeStream.format("json").option("path", lines).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    _put(pages.where("page < 2"), path)
    drain()
    _put(pages.where("page >= 2"), path)
    drain()
    return s.run_to_end(readers.ndjson_events(spark, lines, "page long, pos long, id long, title string, tag string"), spark)
