"""A script's clock: marks, positions, look-ahead, saved places and what becomes of them when the script changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Column = F.Column
BOOKMARK = 1
ID = r"^[A-Za-z0-9_.:-]{1,128}$"


def marks(segments: DataFrame) -> DataFrame:
    """Segments (script, seq, duration) with where each starts and the script's total; negative and null lengths count as none."""
    own = F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0))
    w = Window.partitionBy("script").orderBy("seq")
    start = F.coalesce(F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return segments.withColumn("start", start).withColumn("total", F.sum(own).over(Window.partitionBy("script")))


def held(key: str, time: str, mark: str, tie: str, after: bool = False) -> Column:
    """Over rows that are marks (struct `mark`) and points (null), in the order of time: the last mark of the key not after a
    point, or, with `after`, the first one beyond it. One sort a key; no point meets a mark as a pair. Null times come first."""
    w = Window.partitionBy(key).orderBy(time, F.col(mark).isNull(), tie)
    beyond, until = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.first(mark, True).over(beyond) if after else F.last(mark, True).over(until)


def located(segments: DataFrame, points: DataFrame) -> DataFrame:
    """Of each point (script, seconds) on the clock the segment under it and the offset in it; points of scripts without segments
    don't come out. Segments and points are shuffled once, as one set of rows."""
    asked = points.select("script", F.col("seconds").cast("double").alias("seconds"))
    clock = marks(segments.select("script", "seq", "duration").unionByName(asked, allowMissingColumns=True)).where("total is not null")
    aim = F.greatest(F.lit(0.0), F.least(F.coalesce("seconds", F.lit(0.0)), F.greatest(F.lit(0.0), F.col("total") - 0.25)))
    rows = clock.withColumn("at", F.when(F.col("seq").isNull(), aim).otherwise(F.col("start"))).withColumn("mark", F.when(F.col("seq").isNotNull(), F.struct("seq", "start", "duration")))
    under = rows.withColumn("own", held("script", "at", "mark", "seq")).where("mark is null and own is not null")
    offset = F.greatest(F.lit(0.0), F.least(F.col("at") - F.col("own.start"), F.greatest(F.lit(0.0), F.coalesce("own.duration", F.lit(0.0)) - 0.25)))
    return under.select("script", "seconds", F.col("own.seq").alias("seq"), offset.alias("offset"))


def position_of(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Where places (script, seq, offset) lie on the script's clock; a segment that isn't there begins at 0."""
    starts = marks(segments).select("script", "seq", "start")
    own = F.greatest(F.coalesce("offset", F.lit(0.0)), F.lit(0.0))
    return places.join(starts, ["script", "seq"], "left").select("script", "seq", "offset", (F.coalesce("start", F.lit(0.0)) + own).alias("seconds"))


def passages(segments: DataFrame) -> DataFrame:
    """A script's passages in order, each with the one that follows."""
    return segments.withColumn("next_seq", F.lead("seq").over(Window.partitionBy("script").orderBy("seq")))


def demand(segments: DataFrame, anchors: DataFrame, most: int = 6) -> DataFrame:
    """The segments worth having from each anchor (script, from_seq, seconds, rate, save_data): the anchor's, and those after it
    while what lies between covers less than the seconds at the rate, `most` at most; with save_data the next one alone."""
    speed = F.greatest(F.lit(0.25), F.coalesce(F.nullif("rate", F.lit(0.0)), F.lit(1.0)))
    j = anchors.join(segments, "script").where((F.col("seq") >= F.col("from_seq")) & (F.col("seq") - F.col("from_seq") <= F.when(F.col("save_data"), 1).otherwise(most)))
    own = F.when(F.col("seq") > F.col("from_seq"), F.greatest(F.col("duration"), F.lit(0.0)) / speed).otherwise(0.0)
    w = Window.partitionBy("script", "from_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = j.withColumn("covered", F.coalesce(F.sum(own).over(w), F.lit(0.0)))
    wanted = (F.col("seq") == F.col("from_seq")) | F.col("save_data") | (F.col("covered") < F.col("seconds"))
    return rows.where(wanted).select("script", "from_seq", "seq")


def buffer_seconds(slowness: Column) -> Column:
    return F.when(slowness >= 2, 90).when(slowness >= 1, 60).otherwise(30)


def slowness(deliveries: DataFrame) -> DataFrame:
    """The slowness after all deliveries (key, ord, ready_ms, buffered): a late one adds one up to two, a quick one takes a quarter."""
    items = F.sort_array(F.collect_list(F.struct("ord", "ready_ms", "buffered")))
    gathered = deliveries.groupBy("key").agg(items.alias("d"))

    def step(s: Column, d: Column) -> Column:
        late = d["ready_ms"] / 1000.0 > F.greatest(F.lit(1.0), d["buffered"] * 0.8)
        return F.when(late, F.least(F.lit(2.0), s + 1)).when(d["ready_ms"] < 1500, F.greatest(F.lit(0.0), s - 0.25)).otherwise(s)

    return gathered.select("key", F.aggregate("d", F.lit(0.0), step).alias("slowness"))


def valid_bookmark(b: Column) -> Column:
    """Whether a bookmark struct is one: version, five ids, an offset within a day, a flag."""
    fine = (b["v"] == BOOKMARK) & b["offset_seconds"].between(0, 86_400) & ~F.isnan(b["offset_seconds"]) & b["completed"].isNotNull()
    for key in ("content_revision", "script_id", "rev", "block_id", "segment_id"):
        fine = fine & b[key].rlike(ID)
    return F.coalesce(fine, F.lit(False))


def make_bookmark(segment: Column, offset: Column, completed: Column) -> Column:
    """A bookmark at a segment (content_revision, script_id, rev, block_id, segment_id), the offset to two places."""
    at = F.floor(F.greatest(F.coalesce(offset, F.lit(0.0)), F.lit(0.0)) * 100 + 0.5) / 100
    return F.struct(F.lit(BOOKMARK).alias("v"), *[segment[k].alias(k) for k in ("content_revision", "script_id", "rev", "block_id", "segment_id")], at.alias("offset_seconds"), completed.alias("completed"))


def same_bookmark(a: Column, b: Column) -> Column:
    return F.coalesce((a["rev"] == b["rev"]) & (a["segment_id"] == b["segment_id"]) & (a["completed"] == b["completed"]) & (F.abs(a["offset_seconds"] - b["offset_seconds"]) < 0.01), F.lit(False))


def resume(bookmarks: DataFrame, manifests: DataFrame, old_blocks: DataFrame) -> DataFrame:
    """Where reading goes on: seq, offset and mode for each bookmark (id, script, script_id, rev, block_id, segment_id,
    offset_seconds, completed) against the script's present segments (script, now_script_id, now_rev, seq, segment_id, block_id).

    Completed starts anew; the same audio resumes to the second, the same text at the segment, changed text at the same block,
    else at the first block after it in the old order (old_blocks: script, ord, block_id) that is still there, else 'changed'.
    """
    head = manifests.groupBy("script").agg(F.first("now_script_id").alias("now_script_id"), F.first("now_rev").alias("now_rev"))
    by_segment = manifests.groupBy("script", "segment_id").agg(F.min("seq").alias("seg_seq"))
    by_block = manifests.groupBy("script", "block_id").agg(F.min("seq").alias("block_seq"))
    b = bookmarks.join(head, "script", "left").join(by_segment, ["script", "segment_id"], "left").join(by_block, ["script", "block_id"], "left")
    # the old order, each block with the first surviving one after it: a backward scan within the script
    survivors = old_blocks.join(by_block, ["script", "block_id"], "left")
    after = Window.partitionBy("script").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    nexts = survivors.withColumn("next_seq", F.first("block_seq", ignorenulls=True).over(after)).select("script", "block_id", "next_seq")
    b = b.join(nexts, ["script", "block_id"], "left")
    here = F.col("seg_seq").isNotNull()
    mode = (
        F.when(F.col("completed"), "completed").when(here & (F.col("rev") == F.col("now_rev")), "exact").when(here & (F.col("script_id") == F.col("now_script_id")), "segment")
        .when(F.col("block_seq").isNotNull(), "block").when(F.col("next_seq").isNotNull(), "next-block").otherwise("changed")
    )
    seq = F.when(mode.isin("exact", "segment"), F.col("seg_seq")).when(mode == "block", F.col("block_seq")).when(mode == "next-block", F.col("next_seq")).otherwise(0)
    return b.select("id", seq.cast("long").alias("seq"), F.when(mode == "exact", F.col("offset_seconds")).otherwise(0.0).alias("offset"), mode.alias("mode"))


def segment_for_block(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Of each block (script, ord, block_id) in order the first segment at or after it, and whether it is the block's own."""
    own = segments.groupBy("script", "block_id").agg(F.min("seq").alias("own"))
    w = Window.partitionBy("script").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    j = blocks.join(own, ["script", "block_id"], "left").withColumn("seq", F.first("own", ignorenulls=True).over(w))
    return j.where(F.col("seq").isNotNull()).select("script", "block_id", "seq", F.col("own").isNotNull().alias("exact"))


def manifest(segments: DataFrame, audio: DataFrame) -> DataFrame:
    """Segments with their real length where their audio is there, else the estimate, and which it is."""
    j = segments.join(audio.select("script", "seq", F.col("duration").alias("real")), ["script", "seq"], "left")
    return j.select("script", "seq", F.coalesce("real", "duration").alias("duration"), F.col("real").isNull().alias("estimated"), F.col("real").isNotNull().alias("ready"))


def manifest_totals(m: DataFrame) -> DataFrame:
    return m.groupBy("script").agg(F.round(F.sum("duration"), 2).alias("total"), F.count_if("ready").alias("ready"), F.count(F.lit(1)).alias("segments"))


def legacy_block(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Old seconds (script, seconds) to the old segment they fell in: the first whose running end lies beyond them; captions
    don't count, measured lengths go before estimated ones. Past the end, or in the outro, is completed."""
    rate = F.when(F.col("kind").isin("intro", "outro"), 9.0).when(F.col("kind") == "heading", 12.0).otherwise(15.5)
    length = F.coalesce("measured", F.col("chars") / rate + F.col("pause") / 1000.0)
    spoken = segments.where("kind <> 'caption'").select("script", "seq", "kind", length.alias("length"))
    both = spoken.unionByName(places.where("seconds > 0").select("script", F.col("seconds").cast("double").alias("seconds")), allowMissingColumns=True)
    end = F.when(F.col("seq").isNull(), F.col("seconds")).otherwise(F.sum("length").over(Window.partitionBy("script").orderBy("seq")))
    rows = both.withColumn("at", end).withColumn("mark", F.when(F.col("seq").isNotNull(), F.struct("seq", "kind")))
    out = rows.withColumn("own", held("script", "at", "mark", "seq", after=True)).where("mark is null")
    done = F.col("own").isNull() | (F.col("own.kind") == "outro")
    return out.select("script", "seconds", F.when(~done, F.col("own.seq")).alias("seq"), done.alias("completed"))


def action_label(playing: Column, position: Column, completed: Column) -> Column:
    return F.when(playing, "pause").when(completed, "listen again").when(position > 0, "resume").otherwise("listen")
