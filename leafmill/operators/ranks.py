"""Exact order statistics without holding a key's values anywhere.

The value at a place of a key's sorted values is found by a sort within the key where it has few values. A key with many is
narrowed down first: its values are counted by ranges between the least and the greatest (a row a range, summed before anything
moves), and only the range that holds the wanted place is looked at again, until it is small or all alike. So no task sorts more
than `most` values of a key, however many there are, and nothing is gathered in an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.sources.shared import cut

#: values of a key that are sorted together, and ranges of a round
MOST, RANGES = 65_536, 1024


def place_of(n: Column, p: float) -> Column:
    """The nearest rank, from 0: min(n - 1, floor(n * p))."""
    return F.least(n - 1, F.floor(n * p))


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, places: dict[str, float], most: int = MOST) -> DataFrame:
    """keys and a column for each of `places` (name -> share): the value at that nearest rank among the key's values that aren't
    null, in Spark's order. Keys without values don't come out; rows with a null key are one key, sorted together."""
    rows = rows.select(*keys, F.col(value).alias("_v")).where("_v is not null")
    hot = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where(F.col("n") > most).dropna(subset=keys))
    none_hot = hot.isEmpty()
    few = rows if none_hot else rows.join(_beside(hot.select(*keys)), keys, "left_anti")
    ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    found = ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("_r") == place_of(F.col("_n"), p), F.col("_v"))).alias(name) for name, p in places.items()))
    return found if none_hot else found.unionByName(_of_hot(rows, keys, hot, places, most))


def _of_hot(rows: DataFrame, keys: list[str], hot: DataFrame, places: dict[str, float], most: int) -> DataFrame:
    """The same for keys with many values: `hot` has at most a row for `most` values."""
    named = [hot.select(*keys, F.lit(name).alias("_p"), place_of(F.col("n"), p).alias("place"), "n", "lo", "hi") for name, p in places.items()]
    wanted = cut(reduce(DataFrame.unionByName, named))
    while not (large := wanted.where((F.col("n") > most) & (F.col("lo") < F.col("hi")))).isEmpty():
        inside = rows.join(_beside(large), keys).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        # the least and the greatest are in different ranges, so each round leaves fewer
        share = (F.col("_v").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double"))
        number = F.when(F.col("_v") == F.col("hi"), RANGES).otherwise(F.least(F.lit(RANGES - 1), F.floor(share * RANGES)))
        counts = inside.groupBy(*keys, "_p", "place", number.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(*keys, "_p").orderBy("_b")) - F.col("n")
        narrowed = counts.withColumn("_s", before).where((F.col("_s") <= F.col("place")) & (F.col("place") < F.col("_s") + F.col("n")))
        narrowed = narrowed.select(*keys, "_p", (F.col("place") - F.col("_s")).alias("place"), "n", "lo", "hi")
        wanted = cut(wanted.where((F.col("n") <= most) | (F.col("lo") == F.col("hi"))).unionByName(narrowed))
    alike = wanted.where("lo = hi").select(*keys, "_p", F.col("lo").alias("_v"))
    inside = rows.join(_beside(wanted.where("lo < hi")), keys).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_v")) - 1).where("_r = place").select(*keys, "_p", "_v")
    return alike.unionByName(ranked).groupBy(*keys).agg(*(F.max(F.when(F.col("_p") == name, F.col("_v"))).alias(name) for name in places))


def _small(rows: DataFrame, most: int = 10_000) -> bool:
    """Whether there are few rows, by reading one more than that."""
    return rows.limit(most + 1).count() <= most


def _beside(found: DataFrame) -> DataFrame:
    """What was found of hot keys, sent to the rows where it is small: no task gets all rows of a hot key."""
    return F.broadcast(found) if _small(found) else found
