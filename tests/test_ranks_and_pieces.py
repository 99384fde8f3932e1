"""Order statistics against sorted lists, and pages cut in blank bands against a loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import layout, ranks


def by_hand(values, p):
    values = sorted(v for v in values if v is not None)
    return values[min(len(values) - 1, math.floor(len(values) * p))] if values else None


@pytest.mark.parametrize("most", [3, 40, 10_000])
def test_places_of_few_and_of_many(spark, most):
    rng = random.Random(most)
    groups = {
        "few": [1.5], "ties": [2.0] * 90, "two": [7.0] * 60 + [9.0] * 41, "spread": [rng.gauss(0, 1) for _ in range(500)], "wide": [rng.choice([-1, 1]) * 2.0 ** rng.randint(-300, 300) for _ in range(300)],
        "next": [math.nextafter(1.0, 2.0) if k % 3 else 1.0 for k in range(200)], "nulls": [None, None, 4.0], "none": [None], None: [3.0, -0.5, 8.0] * 30,
    }
    places = {"p0": 0.0, "p15": 0.15, "p50": 0.5, "p92": 0.92, "p1": 1.0}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double").repartition(3)
    got = {r["g"]: tuple(r)[1:] for r in ranks.nearest_ranks(df, ["g"], "v", places, most).collect()}
    want = {g: tuple(by_hand(v, p) for p in places.values()) for g, v in groups.items() if by_hand(v, 0.5) is not None}
    assert got == want


def test_a_key_of_many_values_is_never_sorted_whole(spark):
    rows = spark.range(0, 3_000_000, 1, 4).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.pmod(F.col("id") * 7919, F.lit(1_000_003)).alias("v")).where("k = 0 or id < 900")
    got = {r["k"]: (r["a"], r["b"]) for r in ranks.nearest_ranks(rows, ["k"], "v", {"a": 0.25, "b": 0.999}, most=2000).collect()}
    values = {k: [] for k in (0, 1)}
    for i in range(3_000_000):
        k = int(i % 3 == 0)
        if k == 0 or i < 900:
            values[k].append(i * 7919 % 1_000_003)
    assert got == {k: (by_hand(v, 0.25), by_hand(v, 0.999)) for k, v in values.items()}
    plan = ranks.nearest_ranks(rows, ["k"], "v", {"a": 0.25}, most=2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_empty_and_whole_numbers(spark):
    none = spark.createDataFrame([], "k long, v long")
    assert ranks.nearest_ranks(none, ["k"], "v", {"p": 0.5}).collect() == []
    whole = ranks.nearest_ranks(spark.range(101).selectExpr("id % 2 as k", "id as v"), ["k"], "v", {"p": 0.5}, most=10)
    assert {tuple(r) for r in whole.collect()} == {(0, 50), (1, 51)} and whole.schema["p"].dataType.simpleString() == "bigint"


def pieces_by_hand(blank, target, least=4):
    """The bounds of a page's pieces, cut after cut."""
    cuts, last, height = [], 0, len(blank)
    while height - last > 1.5 * target:
        wanted, best = last + target, None
        first, end = math.floor(last + target * 0.4), min(height - 1, math.floor(wanted + target * 0.6)) + 1
        y = first
        while y < end:
            z = y
            while z < end and blank[z]:
                z += 1
            if z - y >= least:
                score = z - y - 0.5 * abs((y + z) / 2 - wanted)
                if best is None or score > best[0]:
                    best = score, (y + z) // 2
            y = max(z, y + 1)
        if best is None:
            break
        last = best[1]
        cuts.append(last)
    return list(zip([0, *cuts], [*cuts, height], strict=True))


def test_pieces_by_hand(spark):
    rng = random.Random(11)
    pages = {0: [1] * 40, 1: [0] * 300, 2: [1] * 300, 3: [0] * 9}
    for page in range(4, 40):
        rows: list[int] = []
        while len(rows) < rng.randint(20, 400):
            rows += [rng.randint(0, 1)] * rng.randint(1, 25)
        pages[page] = rows
    width = 40  # one dark pixel of a row doesn't count, two do
    bitmap = [(p, y, [0.0] * (rng.randint(0, 1) if b else rng.randint(2, width)) + [255.0] * width) for p, rows in pages.items() for y, b in enumerate(rows)]
    df = spark.createDataFrame(bitmap, "page long, y long, pixels array<double>").repartition(3)
    got: dict[int, list] = {}
    for r in layout.cut_pieces(layout.row_profiles(df, 170.0), 50).orderBy("page", "n").collect():
        got.setdefault(r["page"], []).append((r["top"], r["bottom"]))
    assert got == {p: pieces_by_hand(rows, 50) for p, rows in pages.items()} and max(map(len, got.values())) >= 5
    assert layout.cut_pieces(layout.row_profiles(df.limit(0), 170.0), 50).collect() == []
