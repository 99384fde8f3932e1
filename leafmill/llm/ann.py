"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, each by CENTROIDS centroids fitted by k-means on the SAMPLE vectors with the
least hashes. Every vector lies in the cell of its pair of centroids. A query walks the pairs in order of summed distance
with a heap (multi-sequence traversal) until the cells it has met hold SHARE of all entries (and k at least), then every
entry of those cells is measured exactly, in double precision, on the original vectors.

Queries meet entries by (first centroid, salt, block of queries): entries of a crowded centroid are salted, queries are
dealt into blocks in order of their own cells, so that those of a block visit much the same cells, and neither side of a task
grows with the data. A block says which cells its queries visit; an entry goes to the blocks that visit its cell and to no
other. A query comes once per first centroid, with a mask of the second ones it visits; no pair of rows is made outside the
workers. A group returns k entries a query at most.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do rows
without an id. Rows that share an id are one thing: as a query its smallest vector stands for it, as an entry it is found
once, at the distance of its nearest row, and never by a query of its own id. Ties go to the smaller id. With fewer than k
candidates all are returned; an empty table returns nothing. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm.common import cut, in_arrow

CENTROIDS = 64
SAMPLE = 20_000
SHARE = 0.5
ENTRIES = 20_000
BLOCK = 10_000
#: second centroids in a word of a mask
WORD = 32


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors that take part, as doubles (floats as they are), all of the commonest length (the smaller on ties)."""
    kind = vectors.schema[vector_column].dataType
    v = F.col(vector_column).cast("array<float>" if kind.simpleString() == "array<float>" else "array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_column).isNotNull() & fine).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common[0] if common else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from spread starts; the same for the same rows."""
    k = min(k, len(x))
    starts = [0]
    far = ((x - x[0]) ** 2).sum(1)
    rng = np.random.default_rng(0)
    while len(starts) < k:
        total = far.sum()
        starts.append(int(rng.choice(len(x), p=far / total)) if total > 0 else len(starts))
        far = np.minimum(far, ((x - x[starts[-1]]) ** 2).sum(1))
    c = x[starts].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Pairs of centroids in order of summed distance until they hold `enough` entries; a heap holds the open pairs."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    done = [0] * len(a)  # of each row of pairs, how many are out
    heap, out, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        pair = o1[i], o2[j]
        if counts[pair]:
            out.append(pair)
            held += int(counts[pair])
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


def nearest_ids(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest different ids, each at its nearest row, ties to the smaller id."""
    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    if len(d) > k and len(np.unique(ids[near])) < k:  # rows that share ids: all of them are looked at
        near = np.arange(len(d))
    order = near[np.lexsort((d[near], ids[near]))]
    first = order[np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1])))]
    return first[np.lexsort((ids[first], d[first]))][:k]


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: F.Column | str, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", centroids: int = CENTROIDS, share: float = SHARE, sample: int = SAMPLE, entries_a_task: int = ENTRIES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which `queries` (over vec_id) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    result = "query_id long, rank int, vec_id long, score double"
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # a bounded sample, for the centroids alone
    if fitted.empty:
        return spark.createDataFrame([], result)
    x = np.stack(fitted["v"].to_numpy()).astype(np.float64)
    half = max(1, x.shape[1] // 2)
    c1, c2 = kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids) if x.shape[1] > half else np.zeros((1, 0))
    books = spark.sparkContext.broadcast((half, c1, c2))
    vector = rows.schema["v"].dataType.simpleString()

    def assign(batches):
        half, c1, c2 = books.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(nearest(x[:, :half], c1).astype(np.int32)), pa.array(nearest(x[:, half:], c2).astype(np.int32))], ["vec_id", "v", "c1", "c2"])

    index = in_arrow(rows, assign, f"vec_id long, v {vector}, c1 int, c2 int")
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))  # an id asks once
    counts, asking = np.zeros((len(c1), len(c2)), np.int64), np.zeros((len(c1), len(c2)), np.int64)  # centroids squared at most
    for r in index.withColumn("_asks", F.expr(queries) if isinstance(queries, str) else queries).groupBy("c1", "c2").agg(F.count(F.lit(1)), F.count_if("_asks")).collect():
        counts[r[0], r[1]], asking[r[0], r[1]] = r[2], r[3]
    enough = max(int(np.ceil(share * counts.sum())), k + 1)
    ahead = (np.cumsum(asking) - asking.ravel()).reshape(asking.shape)  # queries in earlier cells
    salts = np.maximum(1, -(-counts.sum(1) // entries_a_task)).astype(int).tolist()
    salts_of = F.array(*[F.lit(s) for s in salts])[F.col("c1")]
    shared = spark.sparkContext.broadcast((counts, asking, ahead))
    words = -(-len(c2) // WORD)

    def visit(batches):
        half, c1, c2 = books.value
        counts, asking, ahead = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch.column("v")), batch.column("vec_id").to_pylist()
            d1, d2 = distances(x[:, :half], c1), distances(x[:, half:], c2)
            at, first, masks, blocks = [], [], [], []
            for q in range(len(x)):
                seen: dict[int, np.ndarray] = {}
                for i, j in traverse(d1[q], d2[q], counts, enough):
                    seen.setdefault(i, np.zeros(words * WORD, np.uint8))[j] = 1
                own = int(d1[q].argmin()), int(d2[q].argmin())
                blocks += [int(ahead[own] + ids[q] % max(1, asking[own])) // block] * len(seen)
                at += [q] * len(seen)
                first += seen
                masks += [np.packbits(m, bitorder="little").view("<u4").astype(np.int64) for m in seen.values()]
            taken = batch.select(["vec_id", "v"]).take(pa.array(at, pa.int32()))
            bits = np.stack(masks) if masks else np.zeros((0, words), np.int64)
            yield pa.RecordBatch.from_arrays([taken.column("vec_id"), taken.column("v"), pa.array(first, pa.int32()), pa.array(blocks, pa.int32()), *(pa.array(bits[:, w]) for w in range(words))], ["vec_id", "v", "c1", "block", *(f"m{w}" for w in range(words))])

    visits = cut(in_arrow(asked, visit, f"vec_id long, v {vector}, c1 int, block int" + "".join(f", m{w} long" for w in range(words))))
    dealt_queries = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), salts_of - 1)))
    wanted = visits.groupBy("c1", "block").agg(*(F.bit_or(f"m{w}").alias(f"m{w}") for w in range(words)))  # a row a block and first centroid
    word = F.array(*(F.col(f"m{w}") for w in range(words)))[F.floor(F.col("c2") / WORD).cast("int")]
    salted = index.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(1)), salts_of).cast("int"))
    dealt_entries = (
        salted.join(wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), salts_of - 1))), ["c1", "salt"])
        .where(F.getbit(word, F.col("c2") % WORD) == 1)
        .select("vec_id", "v", *(F.col(c).alias(f"_{c}") for c in ("c1", "c2", "salt", "block")))
    )

    def rerank(entries: pa.Table, asked: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if entries.num_rows and asked.num_rows:
            x, ids, second = matrix(entries.column("v")), entries.column("vec_id").to_numpy(), entries.column("_c2").to_numpy()
            masks = np.stack([asked.column(f"m{w}").to_numpy() for w in range(words)], 1).astype("<u4").view(np.uint8)
            masks = np.unpackbits(masks, axis=1, bitorder="little").astype(bool)
            for qid, q, mask in zip(asked.column("vec_id").to_pylist(), matrix(asked.column("v")), masks, strict=True):
                met = np.flatnonzero(mask[second] & (ids != qid))
                if not len(met):
                    continue
                d = np.sqrt(((x[met] - q) ** 2).sum(1))
                best = nearest_ids(ids[met], d, k)
                found[0].extend([qid] * len(best))
                found[1].extend(ids[met[best]].tolist())
                found[2].extend(d[best].tolist())
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    near = dealt_entries.groupBy("_c1", "_salt", "_block").cogroup(dealt_queries.groupBy("c1", "salt", "block")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # rows of an id may lie in several cells
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
