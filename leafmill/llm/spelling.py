"""Spelling variants: words of a corpus that differ by one code point, each led to the far more frequent form beside it.

Words are the maximal runs of Latin letters of whole texts, A-Z in lower case; some occurrences are spoilt by one deleted code
point, as the contract says (spoilt()). Counted are words of at least LEAST code points and COMMON occurrences. Two are near
if one inserted, deleted or replaced code point makes one the other.

The join is by pigeonhole. A word of length l is indexed by its two even segments, its first l // 2 code points and the rest.
One edit leaves one of them whole: a word of length l probes the lists of its own length with its own segments, one of length
l + 1 with its first l // 2 code points and with the last ones, which stand shifted by one. As common beginnings and ends make
long lists, a list is split by the same rule: what is outside the shared segment differs by one edit as well, so one of its
two halves is shared too, and is part of the key. Candidates of several keys are one pair; what is outside the shared segment
is compared by edit distance. So a word has eight rows at most whatever the corpus, and a key holds three quarters of a word.

The form is the near word of the most occurrences (ties: least in code-point order), if it has RATIO times the word's; the root
follows forms to the last. Counts grow RATIO-fold a step, so chains are short: they are halved in rounds of one join each.

Counting, with partial counts before the shuffle, is in JVM expressions, and so is all else. Null text has no words; a null id
counts as an empty one. Repeated rows count as often as they are there. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import sql_crc32, written

RUN = "[A-Za-zÀ-ÿ]+"
LEAST = 6
COMMON = 5
RATIO = 5
SPOILT = 199


def lowered(run: Column) -> Column:
    """A-Z alone in lower case. lower() knows more letters but is far faster, and where it changes nothing there is none of A-Z."""
    return F.when(F.lower(run) == run, run).otherwise(F.translate(run, string.ascii_uppercase, string.ascii_lowercase))


def spoilt(ident: Column, run: Column) -> Column:
    """The run; with one code point less where SPOILT divides the crc32 of `<id>:<run>`."""
    h = F.crc32(F.concat(ident, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SPOILT == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(documents: DataFrame, least: int = LEAST, common: int = COMMON) -> DataFrame:
    """word, n: the words of at least `least` code points with at least `common` occurrences."""
    ident = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    runs = documents.select(ident.alias("ident"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= least).select("ident", lowered(F.col("run")).alias("run")).select(spoilt(F.col("ident"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= common)


def segments(words: DataFrame, longer: int) -> DataFrame:
    """The keys of words (word, n) in the lists of words that are shorter by `longer` (0 or 1): length of those, which segment and
    which half of the rest is shared, both, and the rest."""
    length = F.length("word") - longer
    first = F.floor(length / 2).cast("int")
    last = (length - first).cast("int")
    whole = F.length("word")
    keys = []
    for side, shared, rest, halved in (
        (0, F.substring("word", F.lit(1), first), F.substring("word", first + 1, whole), last),
        (2, F.substring("word", whole - last + 1, last), F.substring("word", F.lit(1), whole - last), first),
    ):
        half = F.floor(halved / 2).cast("int")
        ends = (F.substring(rest, F.lit(1), half), F.substring(rest, F.length(rest) - (halved - half) + 1, halved - half))
        keys += [F.struct(length.alias("length"), F.lit(side + k).alias("kind"), shared.alias("shared"), end.alias("half"), rest.alias("rest")) for k, end in enumerate(ends)]
    return words.select("word", "n", F.inline(F.array(*keys)))


def near_pairs(words: DataFrame, least: int = LEAST) -> DataFrame:
    """a, n_a, b, n_b: each pair of near words once."""
    names = ["word", "n", "rest"]
    index = segments(words, 0)
    probes = index.withColumn("longer", F.lit(False)).unionByName(segments(words.where(F.length("word") > least), 1).withColumn("longer", F.lit(True)))
    left = index.select("length", "kind", "shared", "half", *(F.col(c).alias(f"{c}_a") for c in names))
    right = probes.select("length", "kind", "shared", "half", "longer", *(F.col(c).alias(f"{c}_b") for c in names))
    found = left.join(right, ["length", "kind", "shared", "half"]).where((F.col("longer") | (F.col("word_b") > F.col("word_a"))) & (F.levenshtein("rest_a", "rest_b", 1) == 1))
    return found.select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b")).dropDuplicates(["a", "b"])


def forms(words: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """words (word, n) with n_near, form and form_n."""
    ends = near_pairs(words, least).select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_b").alias("near_n"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), F.col("n_a").alias("near_n"), F.col("a").alias("near")),
    )))
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= F.col("n") * ratio
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )


def chains(steps: DataFrame) -> DataFrame:
    """word, root: steps (word, form) followed to the last form. A round joins the table with itself, so the way left is halved."""
    table = written(steps.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "chains")
    while not table.where("moved").isEmpty():
        on = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        table = written(table.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
    return table.select("word", "root")


def spelling_variants(documents: DataFrame, least: int = LEAST, common: int = COMMON, ratio: int = RATIO) -> DataFrame:
    """A row a word: its near words' number, its form and its root."""
    words = written(word_counts(documents, least, common), "words")
    formed = written(forms(words, least, ratio), "forms")
    roots = chains(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in DuckDB's SQL: near words share what is left when a code point goes, at the same place if they are as long.
ORACLE = rf"""
with recursive runs as (
  select doc_id, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents) where length(run) >= 6 group by all
), hashed as (select *, {sql_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from runs
), spoilt as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed
), words as (select word, sum(n)::bigint as n from spoilt where length(word) >= 6 group by word having sum(n) >= 5
), gaps as (select word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as place from words)
), near as (
  select a.word, b.word as near, b.n as near_n from gaps a join gaps b on a.rest = b.rest and a.place = b.place and a.word <> b.word
  union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
  union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word
), best as (select word, count(*) as n_near, max(near_n) as most, min(near) filter (near_n = top) as near from (select *, max(near_n) over (partition by word) as top from near) group by word
), formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when most >= 5 * w.n then near end as form, case when most >= 5 * w.n then most end as form_n from words w left join best using (word)
), walk as (
  select word, word as here, 0 as step from words
  union all select k.word, f.form, step + 1 from walk k join formed f on f.word = k.here where f.form is not null
), roots as (select word, max_by(here, step) as root from walk group by word
)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""
