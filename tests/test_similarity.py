"""The similarity join against all pairs, and folding against Python's Unicode data."""

import collections
import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from leafmill.functions import folding
from leafmill.operators import match, similarity


def words_by_hand(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not "̀" <= c <= "ͯ")
    return [w for w in re.sub("[^a-z0-9]+", " ", plain).split() if len(w) > 1]


def test_folding_of_letters(spark):
    letters = [chr(c) for c in range(1, 0x600) if unicodedata.category(chr(c))[0] in "LNZPSM"] + list("ﬁﬄ½⅓①㎏℡Ⅷⅷ𝐚𝟘ａＡ０ẞĿŀłøßıIİKÅ") + [chr(c) for c in range(0x1E00, 0x1F00)]
    texts = [f"xx{c}yy" for c in letters] + ["café CAFÉ café", "", None, "a b c", "日本語 ab", "tab\tnbsp end"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.w for r in df.select("id", folding.words(F.col("t")).alias("w")).collect()}
    assert {texts[i]: w for i, w in got.items()} == {t: words_by_hand(t) for t in texts}


def test_folding_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", folding.words(F.col("text")).alias("w"))
    assert all(r.w == words_by_hand(r.text) for r in docs.collect())


def dice_by_hand(a, b):
    shared = sum((collections.Counter(a) & collections.Counter(b)).values())
    return 2 * shared / (len(a) + len(b)) if a and b else 0.0


@pytest.mark.parametrize("threshold", [0.3, 0.72, 0.8, 1.0])
def test_similar_is_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    vocabulary, weights = [f"w{k}" for k in range(40)], [1 / (k + 1) for k in range(40)]
    left = [rng.choices(vocabulary, weights, k=rng.randint(0, 14)) for _ in range(40)] + [["w0", "w0", "w0"], ["w0"], ["only", "left"]]
    right = [rng.choices(vocabulary, weights, k=rng.randint(0, 14)) for _ in range(150)] + [["w0", "w0"], ["w0"], None, ["right"] * 9]
    for words in left[:20]:  # near copies: a word changed, one added, another order
        right += [[*words[1:], rng.choice(vocabulary)], [*words, "w0"], words[::-1]]
    right += [left[3]] * 50  # a group of copies
    titles = lambda lists: [(i, None if words is None else " ".join(words).title()) for i, words in enumerate(lists)]
    a = spark.createDataFrame(titles(left), "a long, title string")
    b = spark.createDataFrame(titles(right), "b long, title string").repartition(3)
    want = {(i, j): dice_by_hand(x, y or []) for (i, x), (j, y) in itertools.product(enumerate(left), enumerate(right)) if dice_by_hand(x, y or []) >= threshold}
    got = [((r.a, r.b), r.dice) for r in similarity.similar(a, b, threshold).collect()]
    assert len(got) == len(set(got)) and dict(got) == want and len(want) > 50


def test_pairs_that_meet_are_few(spark):
    """A word of every list is a key of none that has other words, and copies meet once."""
    rows = [(i, f"the of a{i} b{i} c{i}") for i in range(200)]
    a = spark.createDataFrame(rows[:100], "a long, title string")
    b = spark.createDataFrame([*rows, *[(1000 + k, rows[7][1]) for k in range(300)]], "b long, title string")
    own = similarity.bags_of(a.withColumn("bag", F.md5("title")))
    frequency = own.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    keys = {r.key for r in similarity.keys(similarity.ordered(own, frequency), 720).collect()}
    assert not keys & {"the#1", "of#1"}
    assert sorted((r.a, r.b) for r in similarity.similar(a, b, 0.72).collect()) == sorted([(i, i) for i in range(100)] + [(7, 1000 + k) for k in range(300)])


def test_empty_sides(spark):
    none, some = (spark.createDataFrame(rows, "{} long, title string".format(c)) for c, rows in (("a", []), ("b", [(1, "xx yy"), (2, ""), (3, "!")])))
    assert similarity.similar(none, some, 0.5).collect() == [] and similarity.similar(some.withColumnRenamed("b", "c"), none, 0.5).collect() == []


def test_evidence_finds_what_the_title_alone_would_not(spark):
    kind = "{} long, title string, published string, byline string, subtitle string"
    c = spark.createDataFrame([(1, "Discipline comes from having no choice", "2025-04-09", "Jane Doe", None), (2, "nothing like it", None, None, None)], kind.format("candidate"))
    p = spark.createDataFrame([(9, "The discipline that comes from no choice", "2025-04-10", "Jane Doe", None), (8, "Discipline from choice", "2025-06-30", None, None), (7, None, None, None, None)], kind.format("post")).withColumn("line", F.lit(0))
    got = {(r.candidate, r.post): (round(r.score, 6), r.signals) for r in match.scored(c, p).collect()}
    sim = {9: dice_by_hand(words_by_hand("Discipline comes from having no choice"), words_by_hand("The discipline that comes from no choice")), 8: 2 * 3 / 9}
    assert got == {(1, 9): (round(sim[9] + 0.2, 6), ["date", "byline"]), (1, 8): (round(sim[8] - 0.45, 6), [])}
    best = match.best_matches(match.scored(c, p)).collect()
    assert [(r.candidate, r.post, r.accepted) for r in best] == [(1, 9, True)]
