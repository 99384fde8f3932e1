"""Sharding by fixed virtual slots, in DataFrame operations alone.

Records are hashed by id (the first 32 bits of the id's md5, which any engine has) into a fixed number of virtual slots, far
more than there are shards. Rows and bytes are summed per slot. A versioned map, stored in the shared folder, says which
shard holds a slot; the data are never rehashed, only the map is edited, and every place is read from a stored version:

  version 1  deals slots round-robin over the shards
  version 2  grown(): one shard more, which is handed every slot whose turn it is; rows move into it only
  version 3  rebalanced(): version 1 edited by the bytes of the slots. Shards give up what they have above their share, and
             those slots, greatest first, go to the shards that are lightest then; all others stay

The law of shard() is `key`: by versions 1 and 2 the id and the shard count decide. balanced_shard is the place by version 3,
for which bytes decide as well. A null id has a slot as well; null text counts no bytes and has the checksum of nothing;
equal rows lie side by side. Places in a shard are gapless from 0: the offset of the virtual slot within the shard, from the
per-slot counts, plus the row's number within its slot, so no task sees more than a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import fresh_dir, sql_crc32, written

SLOTS = 8192
ROW_OVERHEAD = 16


def slot_of(key: F.Column, slots: int = SLOTS) -> F.Column:
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(bits, F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: vslot, shard, version. As many rows as there are slots, whatever the data."""
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(1).alias("version"))


def grown(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, with one shard more (number `shards`): of each old shard every (shards + 1)th slot moves there, no other does."""
    turn = F.row_number().over(Window.partitionBy("shard").orderBy("vslot"))
    moves = F.pmod(turn + F.col("shard"), F.lit(shards + 1)) == shards
    return slot_map.select("vslot", F.when(moves, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def slot_totals(records: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot; partial sums are made before the shuffle, so at most one row a slot and task moves."""
    return records.groupBy("vslot").agg(F.count(F.lit(1)).alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def rebalanced(slot_map: DataFrame, totals: DataFrame, shards: int, version: int | None = None) -> DataFrame:
    """The next version, by bytes. A slot above an equal share of itself and all lesser ones has a shard to itself: the greatest
    such slot of a shard stays, a further one goes to the lightest shard that has none, and the other slots of these shards
    leave. The share of the rest is what is left, over the other shards. Each of them gives up, greatest first, the slots that
    don't bring it below the share, empty ones never; nothing else moves. What has left goes, greatest first, to the shard that
    is lightest then; a large slot may leave that one above its share, until the next version. Ties go to the lesser number."""
    number = F.lit(version) if version else F.col("version") + 1
    # from here on a row a slot, or a shard: bounded by their numbers, whatever the data
    sized = slot_map.join(totals, "vslot", "left").select("vslot", "shard", number.cast("int").alias("version"), F.coalesce("slot_bytes", F.lit(0)).alias("b"))
    whole, falling = Window.partitionBy(), Window.partitionBy().orderBy(F.desc("b"), "vslot")
    # sums over whole numbers alone, so that no share is a rounded double
    alone = F.col("b") * (shards + 1 - F.row_number().over(falling)) > F.sum("b").over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    judged = sized.withColumn("alone", alone).withColumn("big", F.min("alone").over(falling)).withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("big"), F.desc("b"), "vslot")))
    every = slot_map.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    state = every.join(judged.groupBy("shard").agg(F.max("big").alias("big"), F.sum("b").alias("load")), "shard", "left").select("shard", F.coalesce("big", F.lit(False)).alias("taken"), F.coalesce("load", F.lit(0)).alias("load"))
    extra = judged.where("big and rank > 1").select("vslot", F.row_number().over(falling).alias("turn"))
    free = state.where("not taken").select(F.col("shard").alias("into"), F.row_number().over(Window.orderBy("load", "shard")).alias("turn"))
    given = extra.join(free, "turn").select("vslot", "into")
    closed = state.where("taken").select("shard").unionByName(given.select(F.col("into").alias("shard")))
    share = F.floor(F.sum(F.when(~F.col("big"), F.col("b")).otherwise(0)).over(whole) / F.greatest(shards - F.sum(F.col("big").cast("int")).over(whole), F.lit(1)))
    shared = judged.withColumn("share", share).join(closed.withColumn("closed", F.lit(True)), "shard", "left").join(given, "vslot", "left")
    excess = F.greatest(F.sum("b").over(Window.partitionBy("shard")) - F.col("share"), F.lit(0))
    slots = F.sort_array(F.collect_list(F.struct((-F.col("b")).alias("less"), "vslot")))

    def give(so_far: Column, slot: Column) -> Column:
        goes = (slot["less"] < 0) & (so_far["excess"] + slot["less"] >= 0)
        return F.when(goes, F.struct((so_far["excess"] + slot["less"]).alias("excess"), F.concat(so_far["gone"], F.array(slot["vslot"])).alias("gone"))).otherwise(so_far)

    nothing = F.struct(F.col("excess"), F.array().cast("array<int>").alias("gone"))
    open_ = shared.where("closed is null").withColumn("excess", excess).groupBy("shard", "excess").agg(slots.alias("slots"))
    gone = open_.select(F.explode(F.aggregate("slots", nothing, give)["gone"]).alias("vslot")).withColumn("goes", F.lit(True))
    home = F.when(F.col("into").isNotNull(), F.col("into")).when(F.col("big"), F.col("shard")).when(F.col("closed").isNull() & F.col("goes").isNull(), F.col("shard"))
    placed = shared.join(gone, "vslot", "left").withColumn("home", home)
    held = placed.where("home is not null").groupBy(F.col("home").alias("shard")).agg(F.sum("b").alias("load"))
    opened = every.join(closed, "shard", "left_anti").join(held, "shard", "left")
    loads = opened.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("load", F.lit(0)).alias("load"), "shard"))).alias("loads"))
    leaving = placed.where("home is null").agg(F.sort_array(F.collect_list(F.struct((-F.col("b")).alias("less"), "vslot"))).alias("slots"))

    def place(so_far: Column, slot: Column) -> Column:
        lightest = so_far["loads"][0]
        grown_ = F.struct((lightest["load"] - slot["less"]).alias("load"), lightest["shard"].alias("shard"))
        rest = F.sort_array(F.concat(F.slice(so_far["loads"], 2, shards), F.array(grown_)))
        return F.struct(rest.alias("loads"), F.concat(so_far["into"], F.array(lightest["shard"])).alias("into"))

    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("into"))
    dealt = leaving.join(loads).select("slots", F.aggregate("slots", start, place)["into"].alias("into")).select(F.inline(F.arrays_zip(F.col("slots")["vslot"].alias("vslot"), F.col("into").alias("to"))).alias("vslot", "to"))
    return placed.join(dealt, "vslot", "left").select("vslot", F.coalesce("home", "to").cast("int").alias("shard"), "version")


def write_map(slot_map: DataFrame, path: str) -> None:
    """Stores a version beside the earlier ones; versions are never overwritten."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    version = version or stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version).select("vslot", "shard", "version")


def shard(documents: DataFrame, shards: int = 40, slots: int = SLOTS, id_column: str = "doc_id", text_column: str = "text", maps: str | None = None) -> DataFrame:
    """A row of its place for each record; the three versions of the map are stored under `maps` (a folder of this run's own)."""
    spark = documents.sparkSession
    maps = maps or fresh_dir(spark, "slot-maps")
    records = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_column)), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary")).alias("text_crc32"),
        slot_of(F.col(id_column).cast("long"), slots).alias("vslot"),
    )
    totals = written(slot_totals(records), "slot-totals")
    write_map(first_map(spark, shards, slots), maps)
    write_map(grown(read_map(spark, maps, 1), shards), maps)
    write_map(rebalanced(read_map(spark, maps, 1), totals, shards, version=3), maps)
    now, then, even = (read_map(spark, maps, v).select("vslot", F.col("shard").alias(c)) for v, c in ((1, "shard"), (2, "grown_shard"), (3, "balanced_shard")))
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = now.join(then, "vslot").join(even, "vslot").join(totals, "vslot").withColumn("before", F.coalesce(F.sum("slot_rows").over(earlier), F.lit(0)))
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    # the map has a row a slot at most: 8192 by default, a proven bound
    return (
        records.join(F.broadcast(placed.select("vslot", "shard", "grown_shard", "balanced_shard", "before")), "vslot")
        .withColumn("slot", F.col("before") + F.row_number().over(within) - 1)
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard", "balanced_shard")
    )


#: The same in DuckDB's SQL, for 40 shards and 8192 slots. DuckDB has no CRC-32, so it is spelt out.
ORACLE = f"""
with recursive records as (
  select doc_id, strlen(coalesce(text, '')) + 16 as size, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint % 8192 as vslot, {sql_crc32("coalesce(text, '')")} as text_crc32
  from documents
), totals as (select vslot, count(*) as slot_rows, sum(size)::bigint as slot_bytes from records group by vslot
), map as (select range::bigint as vslot, range % 40 as shard from range(8192)
), turns as (select vslot, shard, case when (row_number() over (partition by shard order by vslot) + shard) % 41 = 40 then 40 else shard end as grown_shard from map
), sized as (select t.*, coalesce(slot_rows, 0) as slot_rows, coalesce(slot_bytes, 0) as b from turns t left join totals using (vslot)
), ranked as (select *, b * (41 - row_number() over w) > sum(b) over (order by b desc, vslot rows between current row and unbounded following) as alone from sized window w as (order by b desc, vslot)
), big as (select *, bool_and(alone) over (order by b desc, vslot) as big from ranked
), judged as materialized (select *, row_number() over (partition by shard order by big desc, b desc, vslot) as rank, sum(b) over (partition by shard) as load, sum(case when big then 0 else b end) over () // (40 - sum(big::int) over ()) as share from big
), extra as (select vslot, row_number() over (order by b desc, vslot) as turn from judged where big and rank > 1
), free as (select shard, row_number() over (order by sum(b), shard) as turn from judged group by shard having not bool_or(big)
), given as (select vslot, shard as into_shard from extra join free using (turn)
), closed as (select shard from judged where big union select into_shard from given
), wide as (select * from judged where shard not in (select shard from closed)
), queue as (select shard, vslot, b, row_number() over (partition by shard order by b desc, vslot) as turn from wide
), gives as (
  select shard, 0 as turn, null::bigint as vslot, false as goes, greatest(max(load) - max(share), 0)::bigint as excess from wide group by shard
  union all
  select q.shard, q.turn, q.vslot, q.b > 0 and q.b <= g.excess, (g.excess - case when q.b <= g.excess then q.b else 0 end)::bigint from gives g join queue q on q.shard = g.shard and q.turn = g.turn + 1
), homes as materialized (select j.*, case when into_shard is not null then into_shard when big then j.shard when j.shard not in (select shard from closed) and j.vslot not in (select vslot from gives where goes) then j.shard end as home from judged j left join given using (vslot)
), leaving as (select vslot, b, row_number() over (order by b desc, vslot) as turn from homes where home is null
), fill as (
  select 0 as turn, null::bigint as vslot, null::bigint as into_shard, (select list_sort(list(struct_pack(load := coalesce(h.load, 0)::bigint, shard := r.shard))) from (select range::bigint as shard from range(40)) r
    left join (select home, sum(b) as load from homes where home is not null group by home) h on h.home = r.shard where r.shard not in (select shard from closed)) as loads
  union all
  select l.turn, l.vslot, f.loads[1].shard, list_sort(list_append(f.loads[2:], struct_pack(load := (f.loads[1].load + l.b)::bigint, shard := f.loads[1].shard))) from fill f join leaving l on l.turn = f.turn + 1
), dealt as (select vslot, into_shard from fill where turn > 0
), placed as (
  select s.vslot, s.shard, s.grown_shard, coalesce(s.home, d.into_shard) as balanced_shard, coalesce(sum(s.slot_rows) over (partition by s.shard order by s.vslot rows between unbounded preceding and 1 preceding), 0) as before
  from homes s left join dealt d using (vslot)
)
select r.doc_id, r.size::bigint as size, r.text_crc32, 'key' as law, p.shard::integer as shard,
  (p.before + row_number() over (partition by r.vslot order by r.doc_id nulls first, r.text_crc32, r.size) - 1)::bigint as slot, p.grown_shard::integer as grown_shard, p.balanced_shard::integer as balanced_shard
from records r join placed p using (vslot)
"""
