"""Single values made fit: clipped, clamped and parsed; stored JSON as rows; what an assessor is shown and what it answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(text: Column, most: int) -> Column:
    """At most so many characters, the last one an ellipsis where some are missing."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def clamped(value: Column, low: float, high: float) -> Column:
    """A number within bounds; the lower one for what isn't a finite number."""
    n = value.try_cast("double")
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return F.when(finite, F.least(F.lit(high), F.greatest(F.lit(low), n))).otherwise(F.lit(low))


def positive_int(value: Column, fallback: int) -> Column:
    """A whole number above 0 that a double holds exactly, else the fallback."""
    n = value.try_cast("double")
    return F.when((n > 0) & (n == F.floor(n)) & (n <= 9007199254740991.0), n.cast("long")).otherwise(F.lit(fallback).cast("long"))


def head_and_tail(text: Column, head: int = 2500, tail: int = 1500, above: int = 5000) -> Column:
    """struct(head, tail) of a text: its beginning, and the end of one that is long enough."""
    return F.struct(F.substring(text, 1, head).alias("head"), F.when(F.length(text) > above, F.right(text, F.lit(tail))).otherwise(F.lit("")).alias("tail"))


def assessed(quality: Column, note: Column, tags: Column, most: int = 3) -> Column:
    """struct(quality, note, tags) of an answer: an unknown quality is full; of the first few tags those with a letter, trimmed, lower case."""
    first = F.transform(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, most), lambda t: F.trim(F.lower(t)))
    return F.struct(F.when(quality.isin("full", "partial", "stub"), quality).otherwise("full").alias("quality"), F.coalesce(note, F.lit("")).alias("note"), F.filter(first, lambda t: t.isNotNull() & (t != "")).alias("tags"))


VARIANT_CONFIG = "struct<voice_id:string,speed:double>"
VARIANT_SCRIPT = "struct<segments:array<struct<id:string,text:string>>,blocks:array<string>>"


def hydrated_variant(config: Column, script: Column) -> Column:
    """struct(config, script) of a stored variant: what doesn't parse is an empty configuration, and a script without parts."""
    empty = F.struct(F.array().cast("array<struct<id:string,text:string>>").alias("segments"), F.array().cast("array<string>").alias("blocks"))
    parsed = F.from_json(script, VARIANT_SCRIPT)
    whole = F.struct(F.coalesce(parsed["segments"], empty["segments"]).alias("segments"), F.coalesce(parsed["blocks"], empty["blocks"]).alias("blocks"))
    return F.struct(F.coalesce(F.from_json(config, VARIANT_CONFIG), F.from_json(F.lit("{}"), VARIANT_CONFIG)).alias("config"), whole.alias("script"))


def hydrated_row(tags: Column, favorite: Column, archived: Column) -> Column:
    """struct(tags, favorite, archived) of a stored row: JSON lists and 0/1 flags as they are meant."""
    return F.struct(F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>")).alias("tags"), (F.coalesce(favorite, F.lit(0)) != 0).alias("favorite"), (F.coalesce(archived, F.lit(0)) != 0).alias("archived"))


def utf16_units(text: Column) -> Column:
    """The UTF-16 code units of a text as whole numbers; none of an empty one."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    last = (F.length(raw) / 4 - 1).cast("int")
    places = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last))
    return F.transform(places, lambda i: F.conv(F.substr(raw, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long"))


def best_srcset(srcset: Column) -> Column:
    """The address of the largest candidate of a srcset by its whole-number descriptor, the first of equals."""
    parts = F.filter(F.transform(F.split(F.trim(srcset), r",\s+"), F.trim), lambda p: p != "")
    size = lambda p: F.coalesce(F.regexp_extract(p, r"\s(\d+)", 1).try_cast("long"), F.lit(0))
    ranked = F.transform(parts, lambda p, i: F.struct((-size(p)).alias("less"), i.alias("at"), F.split_part(p, F.lit(" "), F.lit(1)).alias("url")))
    return F.when(F.size(ranked) > 0, F.array_min(ranked)["url"])
