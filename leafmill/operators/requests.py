"""What comes in with a request, made into columns that the other operators take: page sources, link fallbacks, voices, starts,
progress, and the narration state that goes out with an article."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import rx
from leafmill.operators import library, match, writes
from leafmill.operators.cache import running_before
from leafmill.operators.timeline import ID

Column = F.Column
BOOKMARK = "v int, content_revision string, script_id string, rev string, block_id string, segment_id string, offset_seconds double, completed boolean"


def trimmed(text: Column) -> Column:
    """Without white space around; null for nothing."""
    return F.nullif(F.regexp_replace(text, rx.TRIM, ""), F.lit(""))


def page_source(html: Column) -> Column:
    """The source a browser handed over, as it is, null where it is blank."""
    return F.when(trimmed(html).isNotNull(), html)


def link_fallback(meta: Column) -> Column:
    """What is known of a page that wouldn't open, from a JSON object: five fields of 400 characters at most; null where none is given."""
    fields = [F.substring(trimmed(F.get_json_object(meta, f"$.{k}")), 1, 400).alias(k) for k in ("title", "byline", "site_name", "excerpt", "published_at")]
    return F.when(meta.isNotNull(), F.struct(*fields, F.lit("screenshot").alias("fetch_method")))


def voice_input(id_: Column, name: Column) -> Column:
    """struct(given, id, name): a voice's cleaned id and name; an id that is empty, over 256 characters or holds control characters isn't one."""
    clean = F.regexp_replace(id_, rx.TRIM, "")
    fine = (clean != "") & (F.length(clean) <= 256) & ~clean.rlike(r"[\x00-\x1f\x7f]")
    label = F.substring(F.regexp_replace(F.regexp_replace(name, r"[\x00-\x1f\x7f]", ""), rx.TRIM, ""), 1, 256)
    return F.struct(F.when(id_.isNull(), F.lit("cleared")).when(fine, F.lit("set")).otherwise(F.lit("refused")).alias("given"), F.when(fine, clean).alias("id"), F.when(fine, F.nullif(label, F.lit(""))).alias("name"))


def start_mode(mode: Column, block_id: Column, given: Column) -> Column:
    """resume by default, beginning, block for a well-formed block; null for anything else."""
    return F.when(~given, F.lit("resume")).when(F.coalesce(mode, F.lit("resume")).isin("resume", "beginning"), F.coalesce(mode, F.lit("resume"))).when((mode == "block") & block_id.rlike(ID), F.lit("block"))


def progress(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def with_narration_state(articles: DataFrame, bookmark: str = "audio_bookmark") -> DataFrame:
    """Articles with their content revision and their bookmark parsed; a malformed one is null."""
    parsed = F.from_json(bookmark, BOOKMARK)
    fine = F.coalesce(parsed["v"], parsed["offset_seconds"].cast("int")).isNotNull() | parsed["rev"].isNotNull()
    return articles.withColumn("content_revision", library.content_revision(F.col("title"), F.col("site_name"), F.col("text_content"))).withColumn("bookmark", F.when(fine, parsed))


def synthesis_config(model: str, bitrate: int, speed: float, temperature: float, top_p: float, version: int) -> Column:
    """What a voice is synthesised with, as the struct whose digest goes into a revision."""
    return F.struct(*[F.lit(v).alias(k) for k, v in sorted({"bitrate": bitrate, "model": model, "speed": speed, "temperature": temperature, "top_p": top_p, "version": version}.items())])


def segment_revision(config: Column, text: Column) -> Column:
    """What a spoken segment is known by: how it is synthesised and what is said."""
    return F.substring(F.sha2(F.concat(F.to_json(config), F.lit("\x1f"), F.coalesce(text, F.lit(""))), 256), 1, 31)


def voice_overrides(updates: DataFrame) -> DataFrame:
    """Writes of an article's own voice (key, ord, expected, id, name) in order: refused where the voice isn't one, a conflict where
    the article's version isn't the expected one, else set, or cleared to the default by a null id. Only writes that could be
    taken reach the fold. Returns key, ord, outcome, and for those the version and voice after it."""
    judged = updates.withColumn("v", voice_input(F.col("id"), F.col("name")))
    refused = judged.where("v.given = 'refused'").select("key", F.col("ord").cast("long").alias("ord"), F.lit("refused").alias("outcome"), F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("voice"))
    folded = writes.compare_and_set(judged.where("v.given <> 'refused'").select("key", "ord", "expected", F.to_json(F.struct(F.col("v.given").alias("given"), F.col("v.id").alias("id"))).alias("value")))
    given = F.get_json_object("value", "$.given")
    taken = folded.select("key", "ord", F.when(F.col("ok"), given).otherwise("conflict").alias("outcome"), "version", F.get_json_object("value", "$.id").alias("voice"))
    return taken.unionByName(refused)


def backfill(results: DataFrame) -> DataFrame:
    """Results (ord, ok) of a backlog worked through in order, each with how many were done and failed until then, itself with them;
    counted by parts of 65,536, so no task goes through the whole backlog."""
    counted = results.withColumn("_d", F.col("ok").cast("int")).withColumn("_f", (~F.col("ok")).cast("int"))
    part = F.floor(F.col("ord") / 65_536)
    counted = running_before(running_before(counted, part, ["ord"], "_d", "_done"), part, ["ord"], "_f", "_failed")
    return counted.withColumn("done", F.col("_done") + F.col("_d")).withColumn("failed", F.col("_failed") + F.col("_f")).drop("_d", "_f", "_done", "_failed")


def profile_hosts(candidates: DataFrame, profiles: DataFrame, most: int = 3) -> DataFrame:
    """Hosts found through people: of each candidate (id, byline, poster, publication) the first `most` distinct handles are looked
    up in profiles (handle, profile JSON), their publications' hosts each taken once, in order."""
    handles = F.slice(F.array_distinct(F.concat(*[match.handle_guesses(F.col(c)) for c in ("byline", "poster", "publication")])), 1, most)
    asked = candidates.select("id", F.posexplode(handles).alias("ord", "handle")).join(profiles, "handle")
    hosts = asked.select("id", "ord", F.posexplode(match.publication_hosts(F.col("profile"))).alias("n", "host"))
    return hosts.groupBy("id", "host").agg(F.min(F.struct("ord", "n")).alias("first")).select("id", "host", F.row_number().over(Window.partitionBy("id").orderBy("first")).alias("rank"))
