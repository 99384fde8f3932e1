"""Cache policy as dataflow: eviction under a ceiling, top-k pruning, reconciliation, accounting.

The loops of such a policy are running sums. Where one order covers everything, a running sum is made in two levels, so that
no task sorts the whole cache.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Column = F.Column


def running_before(rows: DataFrame, coarse: Column, order: list[Column | str], amount: str, name: str) -> DataFrame:
    """`amount` summed over all rows before each one, by a coarse part of the order first: its sums are few, the rest of the
    order is only kept within each part."""
    rows = rows.withColumn("_part", coarse)
    sums = rows.groupBy("_part").agg(F.sum(amount).alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    tops = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inner", inner).join(tops, "_part").withColumn(name, F.col("_base") + F.col("_inner")).drop("_part", "_inner", "_base")


def lru_victims(cache: DataFrame, incoming: int, ceiling: int) -> DataFrame:
    """What goes (key) so that `incoming` bytes fit: unprotected entries (key, bytes, used, protected), least recently used
    first, taken while what they free falls short. Nothing goes if even all of them don't make room, or the item is too large."""
    need = cache.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(~F.col("protected"), F.col("bytes"))), F.lit(0)).alias("free"))
    need = need.select((F.col("total") + incoming - ceiling).alias("need"), "free")
    ordered = running_before(cache.where(~F.col("protected")), F.to_date("used"), ["used", "key"], "bytes", "freed")
    fits = (F.lit(incoming) <= ceiling) & (F.col("need") > 0) & (F.col("free") >= F.col("need"))
    return ordered.crossJoin(F.broadcast(need)).where(fits & (F.col("freed") < F.col("need"))).select("key", "bytes", "freed")  # one row of sums


def browser_victims(entries: DataFrame, article: int, need: int) -> DataFrame:
    """Unpinned entries (key, article_id, bytes, used, pinned, protected) before pinned ones, other articles' before this one's,
    oldest first, while they fall short of `need`."""
    mine = (F.col("article_id") == article).cast("int")
    open_ = entries.where(~F.col("protected")).withColumn("_c", F.concat(F.col("pinned").cast("int").cast("string"), mine.cast("string"), F.date_format("used", "yyyyMMdd")))
    return running_before(open_, F.col("_c"), ["used", "key"], "bytes", "freed").where(F.col("freed") < need).select("key", "bytes", "freed")


def kept_variants(variants: DataFrame, keep: int = 3) -> DataFrame:
    """The `keep` most recently used variants (article_id, rev, used, protected) of each article, and the protected ones."""
    rank = F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("used"), "rev"))
    return variants.withColumn("rank", rank).withColumn("kept", (F.col("rank") <= keep) | F.col("protected"))


def orphan_choices(choices: DataFrame, variants: DataFrame) -> DataFrame:
    """Automatic choices (article_id, script_id) whose script has no variant left."""
    return choices.join(variants.select("article_id", "script_id").distinct(), ["article_id", "script_id"], "left_anti")


def reconciled(index: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys that only the index or only the store has, and what is done about each."""
    i, s = index.select(F.col("key").alias("ik")).distinct(), stored.select(F.col("key").alias("sk")).distinct()
    both = i.join(s, F.col("ik") == F.col("sk"), "full_outer").where(F.col("ik").isNull() | F.col("sk").isNull())
    return both.select(F.coalesce("ik", "sk").alias("key"), F.when(F.col("sk").isNull(), "forget").otherwise("delete").alias("action"))


def all_audio(current: DataFrame, legacy: DataFrame, narrations: DataFrame) -> DataFrame:
    """Current and legacy passages (kind, article_id, rev, seq, bytes, used); a legacy one was used when its narration was
    played, or made, or when it was made itself."""
    old = legacy.join(narrations, "article_id", "left").select(F.lit("legacy").alias("kind"), "article_id", F.lit(None).cast("string").alias("rev"), "seq", "bytes", F.coalesce("played_at", "made_at", "created_at").alias("used"))
    return current.select(F.lit("audio").alias("kind"), "article_id", "rev", "seq", "bytes", "used").unionByName(old)


def recent(events: DataFrame, k: int) -> DataFrame:
    """The k keys used last (key, used), newest first, ties by key."""
    return events.groupBy("key").agg(F.max("used").alias("used")).orderBy(F.desc("used"), "key").limit(k)


def status(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Of each variant's wanted passages (variant, seq, duration): how many are there, are all, the bytes the rest may take."""
    have = stored.select("variant", "seq").distinct().withColumn("_h", F.lit(True))
    rows = wanted.join(have, ["variant", "seq"], "left")
    missing = F.when(F.col("_h").isNull(), F.col("duration"))
    return rows.groupBy("variant").agg(F.count("_h").alias("local"), F.count(F.lit(1)).alias("total"), F.bool_and(F.col("_h").isNotNull()).alias("ready"), F.floor(F.coalesce(F.round(F.sum(missing), 2), F.lit(0.0)) * 8000 + 0.5).cast("long").alias("missing_bytes"))


def to_download(wanted: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """Missing passages in order, for variants whose estimated size is within the limit."""
    fits = wanted.groupBy("variant").agg(F.round(F.sum("duration"), 2).alias("_d")).where(F.col("_d") * 8000 <= limit).select("variant")
    return wanted.join(stored.select("variant", "seq").distinct(), ["variant", "seq"], "left_anti").join(fits, "variant", "left_semi")


def obsolete(names: Column, scope: str, version: int) -> Column:
    """Whether a cache's name is of this scope and an older version, or without a scope and below the version."""
    scoped = F.regexp_extract(names, r"^([a-z-]+):([a-z]+)-v(\d+)$", 1)
    v = F.coalesce(F.nullif(F.regexp_extract(names, r"-v(\d+)$", 1), F.lit("")).cast("int"), F.lit(version))
    return F.when(scoped != "", (scoped == scope) & (v < version)).otherwise(v < version)


def wanted_not_running(sessions: DataFrame, running: DataFrame) -> DataFrame:
    """Jobs that sessions' windows (session, key) want and none runs, and running ones that nobody wants."""
    told = sessions.select("key", F.lit(True).alias("_w"), F.lit(False).alias("_r")).unionByName(running.select("key", F.lit(False).alias("_w"), F.lit(True).alias("_r")))
    jobs = told.groupBy("key").agg(F.max("_w").alias("_w"), F.max("_r").alias("_r")).where("_w <> _r")
    return jobs.select("key", F.when(F.col("_w"), "start").otherwise("cancel").alias("action"))
