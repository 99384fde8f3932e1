"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A text's shingles are its runs of SHINGLE words (the words as they stand, split at ASCII white space; a shorter text with a
word is one shingle). A shingle's weight is its number of occurrences. Two documents are linked if their multiset overlap,
sum of least weights over sum of greatest weights, is SIMILARITY or more, or if their texts are equal; a class is a connected
component of links and its id the smallest doc_id in it.

Signatures (BagMinHash). The weight axis is cut into blocks [0,1), [1,2), [2,4), [4,8) ... Each (shingle, block) owns a
Poisson process whose rate is the block's length; every point carries a register and a place in the block. A block that the
weight covers gives all its points; one that it covers in part is halved until the side of a point is known, which is
reading the bits of its place from the top. A register keeps the earliest point it is given, so two signatures agree in a
register with probability exactly the weighted Jaccard similarity. Points are made in order of arrival up to a horizon that
fills all registers of nearly every text, and the horizon is doubled for the rest, so a text of n shingles and m registers
costs about n + m log m points.

Links. Registers are banded; equal bands make buckets. Buckets of two are tested as pairs by exact overlap, each pair once.
Greater ones are groups, dealt into blocks of bounded size; each pair of blocks is a piece of work that computes all its
exact overlaps as products of 0-1 matrices and returns a spanning forest of its links, never its pairs. Buckets of the very
same documents, as many bands make of one family, are one group. Thus every pair of a bucket is linked, joined through
others, or shown to be no link. Links become classes by label propagation with tables in the shared folder.

Equal texts are reduced to their smallest id before (by 128-bit digest, with partial aggregation), so copies cost a row.
Null texts are alike to nothing and stay alone; empty texts and texts of white space are alike only to equal ones. Rows that
share a doc_id are one document; null ids form none and are returned with a null class. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import WordMemory, cut, in_arrow, texts, unused, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
REGISTERS = BANDS * ROWS
#: bytes of words, with their hashes, that a task remembers before it starts anew
MEMO_BYTES = 50_000_000
#: documents, and shingles of documents, in a block
BLOCK_DOCS, BLOCK_ITEMS = 768, 600_000

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_STEPS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(max(SHINGLE, ROWS))], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_hashes(text: str, memo: WordMemory) -> np.ndarray:
    """A 64-bit hash of each shingle, in order."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.learn(set(words)).__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out += h[k : k + len(out)] * _STEPS[k]
    return mixed(out)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes of (shingle, number of its occurrence): sets of them overlap as the multisets do."""
    h = np.sort(hashes)
    if len(h) > 1 and (same := h[1:] == h[:-1]).any():
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
        h = np.sort(np.where(nth > 0, mixed(h + nth.astype(np.uint64) * _GOLDEN), h))
    return h


def bag_minhash(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """A row of register values (ids of the earliest points) for each multiset of distinct hashes with whole weights, none empty."""
    out = np.zeros((len(bags), registers), np.uint64)
    todo, slack = np.arange(len(bags)), 4.0
    while len(todo):
        sizes = [len(bags[i][0]) for i in todo]
        bag = np.repeat(np.arange(len(todo)), sizes)
        h = np.concatenate([bags[i][0] for i in todo])
        w = np.concatenate([bags[i][1] for i in todo]).astype(np.int64)
        horizon = registers * (np.log(registers) + slack) / np.bincount(bag, weights=w)
        x, point, owner = _arrivals(h, w, bag, horizon[bag])
        own = mixed(point ^ _U(0xA5A5A5A5A5A5A5A5))
        slot = owner * registers + (own % _U(registers)).astype(np.int64)
        first = np.full(len(todo) * registers, np.inf)
        np.minimum.at(first, slot, x)
        won = x == first[slot]
        values = np.zeros(len(first), np.uint64)
        values[slot[won]] = own[won]
        out[todo] = values.reshape(len(todo), registers)
        todo = todo[~np.isfinite(first).reshape(len(todo), registers).all(1)]
        slack = 2 * slack + np.log(registers)  # twice the horizon for those that have an empty register
    return out


def _arrivals(h: np.ndarray, w: np.ndarray, bag: np.ndarray, horizon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrival, id and bag of every point that lies under a weight, up to the horizons."""
    found: tuple[list, list, list] = ([], [], [])
    block, low, rate = 0, 0, 1.0  # the block [0, 1), then [1, 2), [2, 4) and so on
    while True:
        seed, x, i = mixed(h ^ _U(block * 0x51ED270B + 1)), np.zeros(len(h)), 0
        own_bag, own_end, own_w = bag, horizon, w
        while len(seed):
            i += 1
            point = mixed(seed + _U(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            x = x - np.log((point >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
            near = np.flatnonzero(x <= own_end)
            seed, x, point, own_bag, own_end, own_w = seed[near], x[near], point[near], own_bag[near], own_end[near], own_w[near]
            if block == 0:  # every weight covers it
                under = slice(None)
            else:  # the block is halved until it is clear whether the point lies under the weight: the bits of its place
                place = low + rate * ((mixed(point + _GOLDEN) >> _U(11)).astype(np.float64) * 2.0**-53)
                under = place < own_w
            found[0].append(x[under])
            found[1].append(point[under])
            found[2].append(own_bag[under])
        low, rate, block = (1, 1.0, 1) if block == 0 else (2 * low, 2.0 * low, block + 1)
        more = w > low
        if not more.any():
            return np.concatenate(found[0]), np.concatenate(found[1]), np.concatenate(found[2])
        h, w, bag, horizon = h[more], w[more], bag[more], horizon[more]


def in_groups(sizes: list[int], most: int = 150_000) -> list[slice]:
    """Slices of successive items of about `most` in sum, one item at least."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            out.append(slice(start, i))
            start, held = i, 0
        held += n
    return [*out, slice(start, len(sizes))] if sizes else out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """Of each row of register values a hash of each band."""
    banded = signature.reshape(len(signature), BANDS, ROWS) * _STEPS[:ROWS]
    return mixed(banded.sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN)


def signatures(documents: DataFrame) -> DataFrame:
    """doc, d1, d2 (digest of the text), n (shingles), bands (null without a word) for each row with an id and a text."""

    def each(batches):
        memo = WordMemory(MEMO_BYTES, xxhash.xxh3_64_intdigest)
        for batch in batches:
            if not batch.num_rows:
                continue
            firsts, seconds, sizes, bags = [], [], [], []
            for text in texts(batch):
                d = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
                firsts.append((d >> 64) - (1 << 63))
                seconds.append((d & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                h = shingle_hashes(text, memo)
                sizes.append(len(h))
                bags.append(np.unique(h, return_counts=True))
            bands: list = [None] * len(bags)
            there = [i for i, b in enumerate(bags) if len(b[0])]
            for part in in_groups([int(bags[i][1].sum()) + 1_000 for i in there]):
                for i, row in zip(there[part], band_hashes(bag_minhash([bags[i] for i in there[part]])).view(np.int64), strict=True):
                    bands[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc", "d1", "d2", "n", "bands"])

    narrow = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return in_arrow(narrow, each, "doc long, d1 long, d2 long, n long, bands array<long>")


def contents(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, items: the occurrence hashes of the wanted documents (table `doc`); others aren't looked at again."""

    def each(batches):
        memo = WordMemory(MEMO_BYTES, xxhash.xxh3_64_intdigest)
        for batch in batches:
            if batch.num_rows:
                items = [occurrences(shingle_hashes(t, memo)).view(np.int64) for t in texts(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(items, pa.list_(pa.int64()))], ["doc", "items"])

    narrow = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return in_arrow(narrow.join(wanted.hint("shuffle_hash"), "doc", "left_semi"), each, "doc long, items array<long>")


def overlaps(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """a, b, j: the exact multiset overlap of the pairs (a, b)."""
    left, right = items.select(F.col("doc").alias("a"), F.col("items").alias("ia")), items.select(F.col("doc").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", (both / (F.size("ia") + F.size("ib") - both)).alias("j"))


def components(links: DataFrame) -> DataFrame:
    """doc, class over the links (a, b): every document takes the smallest id it can reach. Rounds of neighbours' minima
    and of pointer jumping, each written to the shared folder, until nothing changes."""
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = cut(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("class")))
    while True:
        heard = both.join(labels, both["b"] == labels["doc"]).groupBy("a").agg(F.min("class").alias("heard"))
        near = labels.join(heard, labels["doc"] == heard["a"]).select("doc", F.least("class", "heard").alias("class"), F.col("class").alias("old"))
        up = labels.select(F.col("doc").alias("_d"), F.col("class").alias("_c"))
        jumped = cut(near.join(up, near["class"] == up["_d"], "left").select("doc", F.least("class", F.coalesce("_c", "class")).alias("class"), "old"))
        changed = jumped.where("class <> old").limit(1).count()
        labels = jumped.select("doc", "class")
        if not changed:
            return labels


def forest(docs: list[int], items: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents, from the exact overlaps of all their pairs: products of 0-1 matrices
    over the items that two of them have at least, a stretch of items at a time."""
    n = len(docs)
    sizes = np.array([len(x) for x in items], np.float64)
    _, which, counts = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    shared = counts > 1
    column = np.cumsum(shared) - 1
    kept = shared[which]
    owner, which = owner[kept], column[which[kept]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    both = np.zeros((n, n))
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(which, (low, low + 4096))
        m = np.zeros((n, 4096), np.float32)
        m[owner[a:b], which[a:b] - low] = 1
        both += m @ m.T
    linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) * (1 - 1e-12)
    out, unseen = [], np.ones(n, bool)
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root], reached = False, [root]
        while reached:
            i = reached.pop()
            new = np.flatnonzero(linked[i] & unseen)
            unseen[new] = False
            out += [(docs[i], docs[j]) for j in new.tolist()]
            reached += new.tolist()
    return out


def links_within(groups: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: links that join all linked documents of each group (key, doc, n). A group is dealt into blocks of bounded size,
    each pair of blocks is one piece of work, and a piece returns a forest, never its pairs."""
    blocks = groups.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    placed = groups.join(blocks, "key").withColumn("p", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("p")))
    pieces = placed.select("key", "doc", "p", F.explode(others).alias("q")).select("key", "doc", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))

    def each(batches):
        key, docs, held = None, [], []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for k, doc, item in zip(zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q")), strict=True), batch.column("doc").to_pylist(), batch.column("items"), strict=True):
                if k != key:
                    found += forest(docs, held, similarity) if len(docs) > 1 else []
                    key, docs, held = k, [], []
                docs.append(doc)
                held.append(item.values.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], ["a", "b"])
        found = forest(docs, held, similarity) if len(docs) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], ["a", "b"])

    whole = pieces.join(items, "doc").select("key", "p", "q", "doc", "items")
    dealt = whole.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return written(in_arrow(dealt, each, "a long, b long").distinct(), "links")


def near_classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc, class: of every document with an id; class is its own id where nothing is alike."""
    signed = written(signatures(documents), "signatures")
    firsts = written(signed.groupBy("d1", "d2").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands")), "distinct-texts")
    active = firsts.where("bands is not null").select("doc", "n", "bands")

    def crowded(docs: DataFrame, bands: F.Column) -> DataFrame:
        """bucket, doc, n, lo, hi, size over the buckets of two documents or more."""
        rows = docs.select("doc", "n", F.explode(bands).alias("bucket"))
        full = rows.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
        # written, so that both sides of the join are dealt anew and a great bucket's partition can be split
        return rows.join(written(full, "crowded-buckets"), "bucket")

    members = written(crowded(active, F.col("bands")), "members")
    items = written(contents(documents, members.select("doc").distinct()), "contents")
    pairs = members.where("size = 2 and doc = lo").select(F.col("hi").alias("a"), F.col("lo").alias("b")).distinct()
    couples = written(overlaps(pairs, items).where(F.col("j") >= similarity).select("a", "b"), "links")
    # buckets of the same documents, as many bands make of one family, are one group
    crowds = members.where("size > 2").groupBy("bucket").agg(F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("key"), F.first("lo").alias("lo"), F.first("size").alias("size"))
    once = crowds.groupBy("key", "lo", "size").agg(F.min("bucket").alias("bucket")).select("bucket")
    groups = members.where("size > 2").join(once, "bucket", "left_semi").select(F.col("bucket").alias("key"), "doc", "n")
    labels = components(couples.union(links_within(groups, items, similarity)))
    classes = firsts.select("d1", "d2", "doc").join(labels, "doc", "left").select("d1", "d2", F.coalesce("class", "doc").alias("class"))
    return signed.select("doc", "d1", "d2").join(classes, ["d1", "d2"]).groupBy("doc").agg(F.min("class").alias("class"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept (whether it stands for its class) for each row of documents."""
    classes = near_classes(documents, similarity)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = rows.join(classes, F.col("doc_id") == F.col("doc"), "left")
    own = F.coalesce("class", "doc_id")
    return joined.select("doc_id", own.alias("class_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stand for their class, all their columns as they were; rows without an id stay."""
    name = unused(documents, "_gone")
    gone = near_classes(documents, similarity).where("class <> doc").select(F.col("doc").alias(name))
    return documents.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(name), "left_anti")
