"""Queries over single values."""

from pyspark.sql import functions as F

from leafmill.operators import narration
from leafmill.operators import values as v
from leafmill.plans.base import frame, query, values
from leafmill.sources import adapters as src


@query("select doc_id as id, if(length(text) > 140, rtrim(substr(text, 1, 139)) || '…', text) as clip, least(0.9, greatest(0.1, n_chars / 1000.0::double)) as clamp, if(n_chars % 3 = 0, 7, n_chars)::bigint as number from documents")
def clipped_values(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    number = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("-"), F.col("n_chars").cast("string"))).otherwise(F.col("n_chars").cast("string"))
    return d.select(F.col("doc_id").alias("id"), v.clipped(F.col("text"), 140).alias("clip"), v.clamped((F.col("n_chars") / 1000).cast("string"), 0.1, 0.9).alias("clamp"), v.positive_int(number, 7).alias("number"))


_NUMBERS = [(1, "12"), (2, "-3"), (3, "1.5"), (4, "1e3"), (5, "x"), (6, None), (7, "9007199254740993"), (8, "NaN"), (9, "Infinity"), (10, "0")]


@query(f"""with {values("n", "id long, t string", _NUMBERS)}, d as (select id, try_cast(t as double) as n from n)
select id, case when n is null or isnan(n) or isinf(n) then 0.0 else least(100.0, greatest(0.0, n)) end as clamp, case when n > 0 and not isnan(n) and not isinf(n) and n = floor(n) and n <= 9007199254740991 then n::bigint else 5 end as number from d""")
def parsed_numbers(spark, sf_dir):
    n = frame(spark, "id long, t string", _NUMBERS)
    return n.select("id", v.clamped(F.col("t"), 0.0, 100.0).alias("clamp"), v.positive_int(F.col("t"), 5).alias("number"))


@query("select doc_id as id, substr(text, 1, 2500) as head, if(length(text) > 5000, right(text, 1500), '') as tail from documents")
def assessor_excerpt(spark, sf_dir):
    return src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), v.head_and_tail(F.col("text")).alias("x")).select("id", "x.head", "x.tail")


_ANSWERS = [(1, "partial", "cut off", ["News ", "", "  Science", "late"]), (2, "unsure", None, None), (3, "stub", "", ["", "", "", "x"]), (4, None, "n", ["A"])]


@query(f"""with {values("a", "id long, quality string, note string, tags array<string>", _ANSWERS)}
select id, if(quality in ('full', 'partial', 'stub'), quality, 'full') as quality, coalesce(note, '') as note, array_to_string(list_filter(list_transform(coalesce(tags, [])[1:3], lambda t: trim(lower(t))), lambda t: t <> ''), ',') as tags from a""")
def assessor_answers(spark, sf_dir):
    a = frame(spark, "id long, quality string, note string, tags array<string>", _ANSWERS)
    return a.select("id", v.assessed(F.col("quality"), F.col("note"), F.col("tags")).alias("x")).select("id", "x.quality", "x.note", F.array_join("x.tags", ",").alias("tags"))


@query("""select doc_id as id, case when doc_id % 4 = 0 then null else 'v' || doc_id end as voice_id, case when doc_id % 5 = 0 then 0 else 2 end as segments, case when doc_id % 5 = 0 then '' else source end as last_text, case when doc_id % 3 = 0 then 'good,' || lang else '' end as tags, doc_id % 2 = 1 as favorite from documents""")
def hydrated_rows(spark, sf_dir):
    """Stored JSON as rows, with what stands in for text that doesn't parse."""
    d = src.table(spark, sf_dir, "documents")
    config = F.when(F.col("doc_id") % 4 == 0, "{broken").otherwise(F.format_string('{"voice_id": "v%d", "speed": 1.5}', "doc_id"))
    script = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.format_string('{"segments": [{"id": "a", "text": ""}, {"id": "b", "text": "%s"}]}', "source"))
    tags = F.when(F.col("doc_id") % 3 == 0, F.format_string('["good", "%s"]', "lang")).when(F.col("doc_id") % 3 == 1, "not json")
    x = d.select(F.col("doc_id").alias("id"), v.hydrated_variant(config, script).alias("x"), v.hydrated_row(tags, (F.col("doc_id") % 2).cast("int"), F.lit(None).cast("int")).alias("r"))
    return x.select("id", "x.config.voice_id", F.size("x.script.segments").cast("long").alias("segments"), F.coalesce(F.try_element_at("x.script.segments", F.lit(-1))["text"], F.lit("")).alias("last_text"), F.array_join("r.tags", ",").alias("tags"), "r.favorite")


_SETS = [(1, "a.jpg 320w, b.jpg 1024w, c.jpg 640w"), (2, "x.png 1x, y.png 2x, z.png 2x"), (3, "only.gif"), (4, ""), (5, "q.jpg?a=1,2 100w, r.jpg 90w")]


@query(f"""with {values("s", "id long, t string", _SETS)}, p as (select id, unnest(regexp_split_to_array(trim(t), ',\\s+')) as p, unnest(range(9)) as nth from s), c as (select * from p where p is not null and trim(p) <> '')
select s.id, (select arg_max(split_part(trim(p), ' ', 1), (coalesce(try_cast(regexp_extract(trim(p), '\\s(\\d+)', 1) as bigint), 0), -nth)) from c where c.id = s.id) as url from s""")
def largest_source(spark, sf_dir):
    return frame(spark, "id long, t string", _SETS).select("id", v.best_srcset(F.col("t")).alias("url"))


_SPOKEN = [(1, "NASA met Dr. Nguyen at MIT", [("NASA", "nassa"), ("Nguyen", "win")]), (2, "permit MIT MITs", [("mit", "M I T")]), (3, "C++ and C", [("C++", "see plus plus"), ("C", "see")]), (4, "plain", []), (5, None, [("x", "y")]), (6, "aaa", [("a" * 41, "no"), ("", "no"), ("aaa", "bbb"), ("bbb", "ccc")])]


@query(f"""with {values("w", "id long, said string", [(1, "nassa met Doctor win at MIT."), (2, "permit M I T MITs."), (3, "see plus plus and see."), (4, "plain."), (5, ""), (6, "ccc.")])} select id, said as spoken from w""")
def spoken_overrides(spark, sf_dir):
    """Text as it is said with a reader's own pronunciations."""
    rows = spark.createDataFrame([(i, t, [{"find": f, "say": s} for f, s in p]) for i, t, p in _SPOKEN], "id long, text string, pronunciations array<struct<find: string, say: string>>")
    return narration.spoken(rows)
