"""Writes as snapshots: each operator takes the tables as they are and returns them as they will be.

Spark has no keys or triggers; uniqueness, cascades and versions are joins and windows. Each function touches every row of a
table once and shuffles by key; swapping the written snapshot in is the caller's single step (atomic_swap).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import rx
from leafmill.operators.cache import running_before
from leafmill.operators.folds import folded

Column = F.Column
PATCHABLE = ["favorite", "archived", "progress", "read_at", "tags", "quality", "quality_note", "title", "audio_pos", "content_html", "text_content", "word_count", "excerpt", "edited_at"]


def first_of(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def inserted(table: DataFrame, new: DataFrame, key: str = "id", order: str = "arrival") -> DataFrame:
    """New rows with the next numbers in order of arrival, a whole number, appended. The numbering is of the new rows alone."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = running_before(new.withColumn("_one", F.lit(1)), F.floor(F.col(order) / 65_536), [order], "_one", "_n").drop("_one").crossJoin(F.broadcast(top))  # one row
    return table.unionByName(numbered.withColumn(key, (F.col("_top") + F.col("_n") + 1).cast("long")).drop("_n", "_top", order), allowMissingColumns=True)


def patched(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the changes of the allowed columns; a null change leaves what is there. Columns that aren't allowed are passed over."""
    columns = [c for c in changes.columns if c in PATCHABLE and c in table.columns]
    renamed = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(renamed, table[key] == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in table.columns])


def replaced(table: DataFrame, content: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows whose content is fetched anew: the new row's columns, but what the user has made of the old one stays."""
    new = content.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in content.columns if c not in (key, *keep)])
    joined = table.join(new, table[key] == F.col("_k"), "left")
    have = F.col("_k").isNotNull()
    return joined.select(*[F.when(have, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if f"_{c}" in new.columns else c for c in table.columns])


def saved(table: DataFrame, rows: DataFrame, key: str = "url") -> DataFrame:
    """Whether each saved row is new or replaces the one under its key."""
    known = table.select(F.col(key).alias("_k"), F.col("id").alias("old_id"))
    return rows.join(known, rows[key] == F.col("_k"), "left").drop("_k").withColumn("action", F.when(F.col("old_id").isNull(), "insert").otherwise("replace"))


def deleted(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(F.col(key).alias("_k")).distinct(), table[key] == F.col("_k"), "left_anti")


def cascaded(child: DataFrame, gone: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Child rows without those of the deleted parents."""
    return child.join(gone.select(F.col(key).alias("_k")).distinct(), child[foreign] == F.col("_k"), "left_anti")


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that are there stay; of new ones under a key the first to arrive is taken."""
    fresh = first_of(new, keys, order).drop(order)
    return table.unionByName(fresh.join(table.select(*keys), keys, "left_anti"))


def upserted(table: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Under each key the last new row, else the one that was there."""
    last = first_of(new, keys, F.desc(order)).drop(order)
    return last.unionByName(table.join(last.select(*keys), keys, "left_anti"))


def compare_and_set(updates: DataFrame, key: str = "key") -> DataFrame:
    """Updates (key, ord, expected, value) folded in order over version 0: one is taken if it expects the version it meets,
    and makes the next. An update's expected version tells whether it can be taken only with all before it, so this is a
    fold along each key's updates. Returns each update's verdict and the version after it."""
    def step(state: tuple, own: object, ord_: int, expected: int, new: str) -> tuple:
        version, value = state
        ok = expected == version
        if ok:
            version, value = version + 1, new
        return (version, value), (own, ord_, ok, version, value)

    rows = updates.select(key, F.col("ord").cast("long").alias("ord"), "expected", F.col("value").cast("string").alias("value"))
    return folded(rows, key, ["ord"], lambda: (0, None), step, f"{key} {updates.schema[key].dataType.simpleString()}, ord long, ok boolean, version long, value string")


def guarded(variants: DataFrame, revisions: DataFrame) -> DataFrame:
    """Variants (article_id, content_revision, ...) with what their article says: saved, changed meanwhile, or gone."""
    j = variants.join(revisions.select(F.col("id").alias("article_id"), F.col("content_revision").alias("now")), "article_id", "left")
    return j.withColumn("outcome", F.when(F.col("now").isNull(), "not_found").when(F.col("now") != F.col("content_revision"), "content_changed").otherwise("saved")).drop("now")


def touched(table: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their last use brought forward by an access log."""
    last = log.groupBy(*keys).agg(F.max("ts").alias("_ts"))
    return table.join(last, keys, "left").withColumn("used", F.greatest("used", F.coalesce("_ts", "used"))).drop("_ts")


def list_changes(lists: DataFrame, wanted: DataFrame) -> DataFrame:
    """New lists (arrival, name) cleaned and judged: empty, taken (by a list, or by an earlier new one, ASCII case apart), or ok
    with the next position."""
    clean = F.substring(F.regexp_replace("name", rx.TRIM, ""), 1, 40)
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = wanted.select("arrival", clean.alias("name")).withColumn("_f", fold("name"))
    rows = rows.withColumn("_again", F.row_number().over(Window.partitionBy("_f").orderBy("arrival")) > 1)
    known = lists.select(fold("name").alias("_f")).distinct().withColumn("_known", F.lit(True))
    judged = rows.join(known, "_f", "left").withColumn("verdict", F.when(F.col("name") == "", "empty").when(F.col("_known") | F.col("_again"), "taken").otherwise("ok"))
    top = lists.agg(F.coalesce(F.max("position"), F.lit(0)).alias("_top"))
    nth = F.sum(F.when(F.col("verdict") == "ok", 1).otherwise(0)).over(Window.orderBy("arrival"))  # a reader's own lists
    return judged.withColumn("_n", nth).crossJoin(F.broadcast(top)).select("arrival", "name", "verdict", F.when(F.col("verdict") == "ok", F.col("_top") + F.col("_n")).alias("position"))


def edited(old_html: Column, new_html: Column) -> Column:
    """Whether a body changed by more than the marks of what is spoken."""
    plain = lambda h: F.regexp_replace(h, r' data-speech="[^"]*"', "")
    return plain(old_html) != plain(new_html)


def enriched_quality(current: Column, verdict: Column) -> Column:
    """What an assessor makes of the quality: 'partial' stays unless the verdict is 'stub'."""
    return F.when((current == "partial") & (verdict != "stub"), current).otherwise(F.coalesce(verdict, current))


def victim(library: DataFrame, cap: int) -> DataFrame:
    """The oldest article that isn't a favourite, where the library is at its cap; no row where nothing may go."""
    n = library.agg(F.count(F.lit(1)).alias("_n"))
    return library.where(~F.col("favorite")).orderBy("saved_at", "id").limit(1).crossJoin(F.broadcast(n)).where(F.col("_n") >= cap).drop("_n")


def without_list(articles: DataFrame, list_id: int) -> DataFrame:
    return articles.withColumn("collections", F.array_remove("collections", list_id))


def with_member(articles: DataFrame, article_id: int, list_id: int, member: bool) -> DataFrame:
    new = F.array_union("collections", F.array(F.lit(list_id))) if member else F.array_remove("collections", list_id)
    return articles.withColumn("collections", F.when(F.col("id") == article_id, new).otherwise(F.col("collections")))


def persisted(articles: DataFrame, quota: int) -> DataFrame:
    """What a bounded local store keeps: the oldest bodies go blank, one after the other, until the rest fits. `size` is a
    row's characters, `body` those of its body."""
    total = articles.agg(F.sum("size").alias("_total"))
    rows = running_before(articles, F.to_date("saved_at"), ["saved_at", "id"], "body", "_freed").crossJoin(F.broadcast(total))  # one row
    return rows.withColumn("blank", F.col("_total") - F.col("_freed") > quota).drop("_total", "_freed")


def atomic_swap(spark: SparkSession, df: DataFrame, path: str) -> int:
    """Writes a snapshot as the table's next version, path/v<number>, and then names it current by creating path/_current/<number>,
    which fails if it is there. A reader (current()) sees the old version or the new one, never none; a crash before the name
    is created leaves the old one. Versions before the last one go. For one writer."""
    fs, p = _files(spark, path)
    number = max(_versions(spark, path), default=0) + 1
    folder = f"v{number}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    stream = fs.create(p(f"{path}/_current/{number:010d}.{folder}"), False)
    stream.close()
    known = _versions(spark, path)
    for old in sorted(known)[:-2]:
        fs.delete(p(f"{path}/{known[old]}"), True)
        fs.delete(p(f"{path}/_current/{old:010d}.{known[old]}"), False)
    return number


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as its last finished swap has left it."""
    known = _versions(spark, path)
    return spark.read.parquet(f"{path}/{known[max(known)]}")


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Number and folder of the versions that have been named."""
    fs, p = _files(spark, path)
    named = fs.listStatus(p(f"{path}/_current")) if fs.exists(p(f"{path}/_current")) else []
    names = [s.getPath().getName() for s in named]
    return {int(n.split(".")[0]): n.split(".", 1)[1] for n in names if not n.startswith(".")}
