"""Exact similarity join of titles by their words: all pairs whose multisets overlap enough, without a block that could lose one.

Dice of two lists is twice their multiset overlap over both sizes. A list is a set of items (word, which of its occurrences).
Equal titles are one bag, so that copies are made into words and compared once, and join their bag again at the end. Items are put in one order for
all bags: those that the left side doesn't have, then the rarest first. Two bags at or above the threshold share one of their
first items: of a bag of n only the first n - least overlap + 1 are keys, so a frequent word is a key only of bags that have
little else, and items that the left side doesn't have are never kept, only counted. A pair that meets goes on if sizes allow
the threshold and what follows the shared item could still give the overlap; then it moves once, to the bag on the right, where
the lists themselves are compared. Thresholds are whole thousandths, so no bound is a rounded one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.folding import words as words_of
from leafmill.sources.shared import lots_of, written

#: thousandths
UNIT = 1000
#: megabytes of the files that the right side is read from, to a partition of its lists
LOT = 4


def counted(items: Column) -> Column:
    """An array's items with the number of their occurrence: sets of these overlap as the multisets do."""
    # the k-th of equal items in sorted order is told by how far it stands from the first of them
    s = F.sort_array(items)
    return F.transform(s, lambda w, i: F.concat(w, F.lit("#"), (i - F.array_position(s, w) + 1).cast("string")))


def dice(a: Column, b: Column) -> Column:
    """Twice the multiset overlap of two word lists over their sizes."""
    shared = F.size(F.array_intersect(counted(a), counted(b)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * shared / (F.size(a) + F.size(b)))


def up(numerator: Column, denominator: int) -> Column:
    """A whole number's quotient, rounded up."""
    return F.floor((numerator + denominator - 1) / denominator).cast("int")


def overlap_of(n: Column, thousandths: int) -> Column:
    """What a bag of n shares at least with any bag that is similar enough."""
    return up(n * thousandths, 2 * UNIT - thousandths)


def in_reach(n: Column, least: int, most: int, thousandths: int) -> Column:
    """Whether a bag of n can be similar enough to any of least to most."""
    return (n * (2 * UNIT - thousandths) >= least * thousandths) & (n * thousandths <= most * (2 * UNIT - thousandths))


def bags_of(rows: DataFrame, words: DataFrame | None = None, thousandths: int = 0, sizes: tuple[int, int] | None = None, parts: int | None = None) -> DataFrame:
    """bag, n (its size), item of rows (bag, title): equal titles once. Of `words` (word) alone, if given, and then of bags alone
    that have enough of them; of bags alone that are in reach of others of `sizes` (least, most), if given. Titles are shuffled by
    bag, and made into words where they are then; lists are dealt into `parts` before they are counted, so that what a task
    counts doesn't grow with the rows."""
    if sizes:  # a word has two letters and something between it and the next; one character may be several letters
        rows = rows.where((F.length("title") + 1) * (2 * UNIT - thousandths) >= 2 * sizes[0] * thousandths)
    # a generator, as a filter would make the words once for each time that it names them
    fits = F.filter(F.array(words_of(F.col("title"))), lambda w: in_reach(F.size(w), *sizes, thousandths) if sizes else F.size(w) > 0)
    lists = rows.groupBy("bag").agg(F.first("title").alias("title")).select("bag", F.explode(fits).alias("words")).withColumn("n", F.size("words"))
    lists = lists.repartition(parts, "bag") if parts else lists
    lists = lists.select("bag", "n", F.explode("words").alias("word"))
    lists = lists.join(words, "word", "left_semi") if words else lists
    times = lists.groupBy("bag", "n", "word").agg(F.count(F.lit(1)).alias("times"))
    if words:
        times = times.withColumn("m", F.sum("times").over(Window.partitionBy("bag"))).where(F.col("m") >= overlap_of(F.col("n"), thousandths))
    return times.select("bag", "n", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "times"), lambda k: F.concat("word", F.lit("#"), k.cast("string")))).alias("item"))


def ordered(bags: DataFrame, frequency: DataFrame) -> DataFrame:
    """bag, n and the items that have a frequency, rarest first."""
    together = bags.join(frequency, "item").groupBy("bag", "n")
    return together.agg(F.sort_array(F.collect_list(F.struct("often", "item")))["item"].alias("items"))


def keys(bags: DataFrame, thousandths: int) -> DataFrame:
    """The first items of each bag, of which one is shared with any bag that is similar enough, and how many come after each."""
    first = F.size("items") - overlap_of(F.col("n"), thousandths) + 1
    some = bags.where(first > 0)
    return some.select("*", F.posexplode(F.slice("items", F.lit(1), first)).alias("at", "key")).withColumn("after", F.size("items") - F.col("at") - 1).drop("at")


def similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All pairs of rows of left (title and columns of its own) and right (title and others) whose titles' words have a dice of the
    threshold or more, with dice in place of the titles. The left side is the smaller: its lists travel with its keys. Rows
    without words are in no pair."""
    part = round(threshold * UNIT)
    sides = [side.where("title <> ''").withColumn("bag", F.md5(F.col("title").cast("binary"))) for side in (left, right)]
    own = written(bags_of(sides[0]), "items")
    ends = own.agg(F.coalesce(F.min("n"), F.lit(1)).alias("least"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    parts = lots_of(right, LOT)
    others = written(bags_of(sides[1], own.select(F.substring_index("item", "#", 1).alias("word")).distinct(), part, (ends["least"], ends["most"]), parts), "items")
    frequency = own.select("item").distinct().join(others.groupBy("item").agg(F.count(F.lit(1)).alias("often")), "item", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    frequency = written(frequency, "often")  # a file of its own says how small it is, so that items aren't dealt by it then
    few, many = ordered(own, frequency), written(ordered(others.repartition(parts, "bag"), frequency), "bags")

    probes = keys(few, part).select("key", F.col("bag").alias("few"), F.col("items").alias("few_items"), F.col("n").alias("few_n"), F.col("after").alias("few_after"))
    sizes = (F.col("n") * (2 * UNIT - part) >= F.col("few_n") * part) & (F.col("few_n") * (2 * UNIT - part) >= F.col("n") * part)
    wanted = up((F.col("n") + F.col("few_n")) * part, 2 * UNIT)
    met = keys(many, part).select("key", "bag", "n", "after").join(probes, "key").where(sizes & (F.least("after", "few_after") + 1 >= wanted))
    # by bag, as the lists are: one shuffle for leaving out what has met twice and for the comparison
    pairs = met.select("bag", "few", "few_items", "few_n").repartition(parts, "bag").dropDuplicates(["bag", "few"]).join(many, "bag")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("items", "few_items"))).where(F.col("shared") * (2 * UNIT) >= (F.col("n") + F.col("few_n")) * part)
    found = pairs.select("bag", "few", (2.0 * F.col("shared") / (F.col("n") + F.col("few_n"))).alias("dice"))
    kept = [side.drop("title") for side in sides]
    return found.join(kept[0].withColumnRenamed("bag", "few"), "few").join(kept[1], "bag").drop("bag", "few")
