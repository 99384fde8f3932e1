"""Queries over a script's clock."""

from pyspark.sql import functions as F

from leafmill.operators import timeline as t
from leafmill.plans.base import frame, query, values
from leafmill.sources import adapters as src

WITH = f"""with {src.SEGMENTS_SQL}, m as (select *, coalesce(sum(duration) over (partition by script order by seq rows between unbounded preceding and 1 preceding), 0) as start, sum(duration) over (partition by script) as total from segments)"""


@query(f"{WITH} select script, seq, duration, round(start, 4) as start, round(total, 4) as total from m")
def timeline_marks(spark, sf_dir):
    return t.marks(src.segments(spark, sf_dir)).select("script", "seq", "duration", F.round("start", 4).alias("start"), F.round("total", 4).alias("total"))


@query(f"""{WITH}, p as (select script, unnest([-5.0, 0.1, 20.07, 77.7, 1e9]::double[]) as seconds from (select distinct script from segments)),
j as (select p.script, seconds, m.seq, m.start, m.duration, greatest(0, least(seconds, greatest(0, total - 0.25))) as t from p join m on m.script = p.script), k as (select *, row_number() over (partition by script, seconds order by seq desc) as r from j where start <= t)
select script, seconds, seq, round(greatest(0, least(t - start, greatest(0, duration - 0.25))), 4) as offset_s from k where r = 1""")
def timeline_locate(spark, sf_dir):
    s = src.segments(spark, sf_dir)
    points = s.select("script").distinct().withColumn("seconds", F.explode(F.array(*map(F.lit, (-5.0, 0.1, 20.07, 77.7, 1e9)))))
    return t.located(s, points).select("script", "seconds", "seq", F.round("offset", 4).alias("offset_s"))


@query(f"""{WITH}, p as (select script, seq + 1 as seq, (seq % 3 - 1) * 1.5::double as offset_s from segments) select p.script, p.seq, round(coalesce(m.start, 0) + greatest(0, offset_s), 4) as seconds from p left join m on m.script = p.script and m.seq = p.seq""")
def timeline_position(spark, sf_dir):
    """Places one segment on, with offsets before, at and after its beginning; past the last there is none."""
    s = src.segments(spark, sf_dir)
    places = s.select("script", (F.col("seq") + 1).alias("seq"), ((F.col("seq") % 3 - 1) * 1.5).alias("offset"))
    return t.position_of(s, places).select("script", "seq", F.round("seconds", 4).alias("seconds"))


@query(f"""{WITH} select script, seq, block_id, lead(seq) over (partition by script order by seq) as next_seq from segments""")
def passage_scan(spark, sf_dir):
    return t.passages(src.segments(spark, sf_dir)).select("script", "seq", "block_id", "next_seq")


@query(f"""{WITH}, a as (select script, seq as from_seq, case when script % 2 = 0 then 30.0 else 90.0 end as seconds, case when script % 3 = 0 then 2.0 else 1.0 end as rate, script % 7 = 0 as save_data from segments where seq % 2 = 0),
j as (select a.script, from_seq, s.seq, seconds, save_data, coalesce(sum(case when s.seq > from_seq then s.duration / rate else 0 end) over (partition by a.script, from_seq order by s.seq rows between unbounded preceding and 1 preceding), 0) as covered from a join segments s on s.script = a.script and s.seq >= from_seq and s.seq - from_seq <= case when save_data then 1 else 6 end)
select script, from_seq, seq from j where seq = from_seq or save_data or covered < seconds""")
def demand_window(spark, sf_dir):
    s = src.segments(spark, sf_dir)
    a = s.where("seq % 2 = 0").select("script", F.col("seq").alias("from_seq"), F.when(F.col("script") % 2 == 0, 30.0).otherwise(90.0).alias("seconds"), F.when(F.col("script") % 3 == 0, 2.0).otherwise(1.0).alias("rate"), (F.col("script") % 7 == 0).alias("save_data"))
    return t.demand(s, a)


_RESUME = f"""{WITH}, now as (select script, 's' || script % 2 as now_script_id, 'r' || script % 3 as now_rev, seq, 'g' || seq as segment_id, block_id from segments where seq % 3 <> 1),
old as (select script, seq as ord, block_id from segments), b as (select script * 100 + seq as id, script, 's' || seq % 2 as script_id, 'r' || seq % 3 as rev, block_id, 'g' || seq as segment_id, seq + 0.5 as offset_seconds, seq = 8 as completed from segments)"""


@query(f"""{_RESUME}, x as (select b.*, (select any_value(now_script_id) from now where now.script = b.script) as nsid, (select any_value(now_rev) from now where now.script = b.script) as nrev, (select min(seq) from now where now.script = b.script and now.segment_id = b.segment_id) as seg, (select min(seq) from now where now.script = b.script and now.block_id = b.block_id) as blk,
  (select min_by(n.seq, o2.ord) from old o1 join old o2 on o2.script = o1.script and o2.ord > o1.ord join (select script, block_id, min(seq) as seq from now group by all) n on n.script = o2.script and n.block_id = o2.block_id where o1.script = b.script and o1.block_id = b.block_id) as nxt from b),
y as (select *, case when completed then 'completed' when seg is not null and rev = nrev then 'exact' when seg is not null and script_id = nsid then 'segment' when blk is not null then 'block' when nxt is not null then 'next-block' else 'changed' end as mode from x)
select id, case when mode in ('exact', 'segment') then seg when mode = 'block' then blk when mode = 'next-block' then nxt else 0 end as seq, case when mode = 'exact' then offset_seconds else 0 end::double as offset_s, mode from y""")
def bookmark_resolve(spark, sf_dir):
    s = src.segments(spark, sf_dir)
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    now = s.where("seq % 3 <> 1").select("script", text("s", F.col("script") % 2).alias("now_script_id"), text("r", F.col("script") % 3).alias("now_rev"), "seq", text("g", F.col("seq")).alias("segment_id"), "block_id")
    b = s.select((F.col("script") * 100 + F.col("seq")).alias("id"), "script", text("s", F.col("seq") % 2).alias("script_id"), text("r", F.col("seq") % 3).alias("rev"), "block_id", text("g", F.col("seq")).alias("segment_id"), (F.col("seq") + 0.5).cast("double").alias("offset_seconds"), (F.col("seq") == 8).alias("completed"))
    return t.resume(b, now, s.select("script", F.col("seq").alias("ord"), "block_id")).select("id", "seq", F.col("offset").alias("offset_s"), "mode")


@query(f"""{WITH}, g as (select script, seq, block_id from segments where seq % 3 = 2) select o.script, o.block_id, (select min(seq) from g where g.script = o.script and g.seq >= o.seq) as seq, o.seq % 3 = 2 as exact from segments o where exists (select 1 from g where g.script = o.script and g.seq >= o.seq)""")
def next_block(spark, sf_dir):
    s = src.segments(spark, sf_dir)
    return t.segment_for_block(s.select("script", F.col("seq").alias("ord"), "block_id"), s.where("seq % 3 = 2"))


@query(f"""{WITH}, a as (select script, seq, duration + 0.5 as d from segments where (script + seq) % 2 = 0) select s.script, round(sum(coalesce(a.d, s.duration)), 2) as total, count(a.seq) as ready, count(*) as segments from segments s left join a on a.script = s.script and a.seq = s.seq group by s.script""")
def manifest_totals(spark, sf_dir):
    s = src.segments(spark, sf_dir)
    return t.manifest_totals(t.manifest(s, s.where((F.col("script") + F.col("seq")) % 2 == 0).withColumn("duration", F.col("duration") + 0.5)))


_MARKS = [(1, 1, "c", "s", "r", "b", "g", 5.006, False), (2, 2, "c", "s", "r", "b", "g", 5.0, False), (3, 1, "c", "s", "r", "b b", "g", 5.0, False), (4, 1, "c", "s", "r", "b", "g", 86401.0, False), (5, 1, "c", "s", "r", "b", "g", 1.0, None), (6, 1, "c", None, "r", "b", "g", 1.0, True), (7, 1, "c", "s", "r", "b", "g", -1.0, True)]
_MC = "id long, v int, content_revision string, script_id string, rev string, block_id string, segment_id string, offset_seconds double, completed boolean"
_IDS = " and ".join(f"regexp_matches({k}, '{t.ID}')" for k in ("content_revision", "script_id", "rev", "block_id", "segment_id"))


@query(f"""with {values("m", _MC, _MARKS)} select id, coalesce(v = 1 and offset_seconds between 0 and 86400 and completed is not null and {_IDS}, false) as valid, floor(greatest(offset_seconds, 0) * 100 + 0.5) / 100 as made_offset, coalesce(completed = false and abs(offset_seconds - 5.0) < 0.01, false) as same from m""")
def bookmark_valid(spark, sf_dir):
    m = frame(spark, _MC, _MARKS).withColumn("b", F.struct("v", "content_revision", "script_id", "rev", "block_id", "segment_id", "offset_seconds", "completed"))
    made = t.make_bookmark(F.col("b"), F.col("offset_seconds"), F.col("completed"))
    other = F.struct(F.lit("r").alias("rev"), F.lit("g").alias("segment_id"), F.lit(False).alias("completed"), F.lit(5.0).alias("offset_seconds"))
    return m.select("id", t.valid_bookmark(F.col("b")).alias("valid"), made["offset_seconds"].alias("made_offset"), t.same_bookmark(F.col("b"), other).alias("same"))


@query(f"""{WITH}, o as (select script, seq, case when seq = 0 then 'intro' when seq % 5 = 4 then 'caption' when seq % 3 = 0 then 'heading' else 'text' end as kind, cast(duration * 15.5 as int) as chars, 200 as pause, case when seq % 2 = 0 then duration end as measured from segments),
e as (select *, sum(coalesce(measured, chars / case kind when 'intro' then 9.0 when 'heading' then 12.0 else 15.5 end::double + pause / 1000.0::double)) over (partition by script order by seq) as stop from o where kind <> 'caption'),
p as (select script, unnest([0.0, 3.01, 40.01, 5000.01]::double[]) as seconds from (select distinct script from segments)), f as (select p.script, seconds, min(e.seq) as seq from p join e on e.script = p.script and seconds < stop where seconds > 0 group by all)
select p.script, p.seconds, f.seq, f.seq is null as completed from p left join f on f.script = p.script and f.seconds = p.seconds where p.seconds > 0""")
def legacy_position(spark, sf_dir):
    s = src.segments(spark, sf_dir)
    kind = F.when(F.col("seq") == 0, "intro").when(F.col("seq") % 5 == 4, "caption").when(F.col("seq") % 3 == 0, "heading").otherwise("text")
    old = s.select("script", "seq", kind.alias("kind"), F.floor(F.col("duration") * 15.5 + 0.5).alias("chars"), F.lit(200).alias("pause"), F.when(F.col("seq") % 2 == 0, F.col("duration")).alias("measured"))
    points = s.select("script").distinct().withColumn("seconds", F.explode(F.array(*map(F.lit, (0.0, 3.01, 40.01, 5000.01)))))
    return t.legacy_block(old, points)


_DELIVERIES = [(1, i, ms, b) for i, (ms, b) in enumerate([(5000.0, 1.0), (5000.0, 1.0), (100.0, 9.0), (2000.0, 9.0)])] + [(2, 0, 100.0, 5.0), (2, 1, 9000.0, 5.0)] + [(3, i, 100.0, 1.0) for i in range(3)]


@query("select * from (values (1, 1.75::double, 60), (2, 1.0, 60), (3, 0.0, 30)) t(key, slowness, buffer)")
def slowness_fold(spark, sf_dir):
    return t.slowness(frame(spark, "key long, ord long, ready_ms double, buffered double", _DELIVERIES)).withColumn("buffer", t.buffer_seconds(F.col("slowness")))


@query("select doc_id as id, case when doc_id % 9 = 0 then 'pause' when doc_id % 5 = 0 then 'listen again' when doc_id % 4 > 0 then 'resume' else 'listen' end as label from documents")
def player_action(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), t.action_label(F.col("doc_id") % 9 == 0, F.col("doc_id") % 4, F.col("doc_id") % 5 == 0).alias("label"))


@query(f"""{WITH} select s.script * 100 + s.seq as id from segments s where (s.script + s.seq) % 4 <> 0 and exists (select 1 from segments v where v.script = s.script and v.seq % 2 = 0 and v.block_id = s.block_id)""")
def bookmark_foreign_key(spark, sf_dir):
    """Bookmarks whose segment is in the variant with the same block; those of old audio are exempt and not asked."""
    s = src.segments(spark, sf_dir)
    variant = s.where("seq % 2 = 0").select("script", "block_id")
    return s.where((F.col("script") + F.col("seq")) % 4 != 0).join(variant, ["script", "block_id"], "left_semi").select((F.col("script") * 100 + F.col("seq")).alias("id"))
