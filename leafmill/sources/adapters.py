"""The engine's tables, derived from the driver's: the same integer and string expressions stand in the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: F.Column) -> F.Column:
    """Items between white space."""
    return F.size(F.filter(F.split(text, "[ \\n\\t\\r]+"), lambda x: x != ""))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as saved articles. Columns that a query doesn't select aren't computed, nor their inputs read."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l"), "quality")
    saved = F.timestamp_add("MINUTE", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return d.join(labels, F.col("doc_id") == F.col("_l"), "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("site_name"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("By Jane Doe of the "), F.upper("source"))).when(F.col("doc_id") % 3 == 1, F.lit("By Érik Ravn")).alias("byline"),
        F.col("text").alias("text_content"),
        F.trim(F.substring("text", 1, 300)).alias("excerpt"),
        word_count(F.col("text")).cast("long").alias("word_count"),
        saved.alias("saved_at"),
        F.when(F.col("doc_id") % 3 != 0, saved + F.expr("interval 1 day")).alias("read_at"),
        (F.col("doc_id") % 7 == 0).alias("favorite"),
        (F.col("doc_id") % 11 == 0).alias("archived"),
        F.when(F.col("quality") == 1, F.array(F.lit("good"))).when(F.col("quality") == 0, F.array(F.lit("poor"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        ((F.col("doc_id") % 100) / 100.0).alias("progress"),
        F.col("lang").alias("lang"),
    )


def collections(spark: SparkSession) -> DataFrame:
    return spark.range(1, 6).select("id", F.concat(F.lit("List "), F.col("id").cast("string")).alias("name"), F.col("id").alias("position"))


def article_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    halves = ids.where("doc_id % 2 = 0").selectExpr("doc_id as article_id", "1 + doc_id % 5 as collection_id")
    fifths = ids.where("doc_id % 5 = 0").selectExpr("doc_id as article_id", "1 + doc_id % 3 as collection_id")
    return halves.union(fifths).distinct()


def audio_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as key", "o_custkey as article_id", "cast(o_totalprice as long) as bytes", "o_orderdate as used", "o_orderkey % 13 = 0 as protected")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a script: a segment a turn, its length in seconds from its characters."""
    # renamed before the window, so that windows over a script find its partitioning
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("script"), "turn", F.round(F.length("text") / 15.5, 2).alias("duration"), F.concat(F.lit("b"), "role", F.lit("-"), F.col("turn").cast("string")).alias("block_id"))
    seq = F.row_number().over(Window.partitionBy("script").orderBy("turn")) - 1
    return turns.select("script", seq.cast("long").alias("seq"), "duration", "block_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id as key", "value as ms", "ts", "event_type")


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.split(F.lower("p_type"), " ").alias("tags"), F.col("p_retailprice").cast("long").alias("popularity"))


#: The same tables for the oracles, as common table expressions of DuckDB.
ARTICLES_SQL = """articles as (
  select d.doc_id as id, 'https://' || source || '.example.org/' || lang || '/' || d.doc_id as url, source as site_name,
    substr(split_part(text, chr(10), 1), 1, 80) as title, case d.doc_id % 3 when 0 then 'By Jane Doe of the ' || upper(source) when 1 then 'By Érik Ravn' end as byline, text as text_content, trim(substr(text, 1, 300)) as excerpt,
    len(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '')) as word_count,
    timestamp '2024-01-01 00:00:00' + to_minutes(d.doc_id) as saved_at,
    case when d.doc_id % 3 <> 0 then timestamp '2024-01-01 00:00:00' + to_minutes(d.doc_id) + interval 1 day end as read_at,
    d.doc_id % 7 = 0 as favorite, d.doc_id % 11 = 0 as archived,
    case quality when 1 then ['good'] when 0 then ['poor'] else [] end as tags, (d.doc_id % 100) / 100.0::double as progress, lang
  from documents d left join labels l on d.doc_id = l.doc_id)"""
COLLECTIONS_SQL = "collections as (select range as id, 'List ' || range as name, range as position from range(1, 6))"
MEMBERS_SQL = """article_collections as (
  select doc_id as article_id, 1 + doc_id % 5 as collection_id from documents where doc_id % 2 = 0
  union select doc_id, 1 + doc_id % 3 from documents where doc_id % 5 = 0)"""
CACHE_SQL = "audio_cache as (select o_orderkey as key, o_custkey as article_id, cast(floor(o_totalprice) as bigint) as bytes, o_orderdate as used, o_orderkey % 13 = 0 as protected from orders)"
SEGMENTS_SQL = """segments as (
  select conv_id as script, row_number() over (partition by conv_id order by turn) - 1 as seq, round(length(text) / 15.5, 2) as duration, 'b' || role || '-' || turn as block_id
  from conversations)"""
VOICES_SQL = "voices as (select p_partkey as id, p_name as title, string_split(lower(p_type), ' ') as tags, cast(floor(p_retailprice) as bigint) as popularity from part)"
