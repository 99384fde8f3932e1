"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Features are the n-grams of N successive bytes of a text's UTF-8 form, hashed into BUCKETS buckets. Two multinomials over
the buckets are counted: the raw one over every n-gram of every document, the target one over those of trusted documents
(labelled rows of quality 1 and toxic 0; of each slot a bounded sample, the TRUSTED ones with the least hashes). There is a
pair of them for each of SLOTS language slots (a hash of `lang`), so that a target with another mix of languages than the
corpus doesn't condemn one; a language without trusted documents has ratios of 0. A document's score is the mean over its
n-grams of log p_target(bucket) - log p_raw(bucket), so it doesn't grow with length; a document is kept if it passes the
base rules and scores THRESHOLD or more.

The prior pulls the ratios of a slot with few trusted n-grams to 0. A bucket that no trusted document has gets the least
ratio, log(prior / (n-grams + prior)), and scores keep their places between it and 0; so where it is nearer to 0 than DEPTH,
the slot's scores are stretched as if it was -DEPTH, and THRESHOLD means the same with one trusted document as with many.

The sample takes the ids and slots of labelled documents, two narrow shuffles. Counting is one scan: each task adds up arrays of SLOTS * BUCKETS numbers and sends as many rows at most, then sums meet by
bucket; the model that is handed back to the tasks has SLOTS * BUCKETS numbers, whatever the corpus. Scoring is a second
scan. No text moves.

Null text: no words, base_failed. Null lang is a slot's language as any other. Empty corpus or no trusted documents: every
ratio is 0, and the base rules alone decide.
Repeated rows count as often as they are there and get equal results; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import ASCII_SPACE, WordMemory, arrow_map, cut, in_arrow, texts

N = 4
BUCKETS = 1 << 15
SLOTS = 48
TRUSTED = 20_000
PRIOR = 1.0
THRESHOLD = -0.4
DEPTH = 2.0
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: bytes of words, with their hashes, that a task remembers before it starts anew
MEMO_BYTES = 80_000_000

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def gram_buckets(raw: bytes) -> np.ndarray:
    """Bucket of every n-gram of N bytes; a shorter text is one n-gram, padded with zero bytes, an empty one none."""
    if not raw:
        return np.empty(0, np.uint32)
    b = np.frombuffer(raw.ljust(N, b"\0"), np.uint8).astype(np.uint32)
    codes = b[: len(b) - N + 1].copy()
    for k in range(1, N):
        codes |= b[k : len(b) - N + 1 + k] << np.uint32(8 * k)
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(0x2C1B3C6D)
    codes ^= codes >> np.uint32(12)
    codes *= np.uint32(0x297A2D39)
    return codes >> np.uint32(32 - BUCKETS.bit_length() + 1)


def slot(lang: str | None) -> int:
    """The first bucket of a language's own."""
    return zlib.crc32((lang or "").encode()) % SLOTS * BUCKETS


def word_hashes() -> WordMemory:
    return WordMemory(MEMO_BYTES, xxhash.xxh3_64_intdigest)


def repeated_words(words: list[bytes], memo: WordMemory) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the text. Hashes find the windows, words confirm them."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(memo.learn(set(words)).__getitem__, words), np.uint64, n)
    count = n - WINDOW + 1
    mixed = np.zeros(count, np.uint64)
    for k in range(WINDOW):
        mixed += h[k : k + count] * _MULTIPLIERS[k]
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    suspects = np.flatnonzero(np.isin(mixed, twice)).tolist()
    seen = Counter(tuple(words[i : i + WINDOW]) for i in suspects)
    covered = np.zeros(n, bool)
    for i in suspects:
        if seen[tuple(words[i : i + WINDOW])] > 1:
            covered[i : i + WINDOW] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """\\n-split lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    return sum(c - 1 for line, c in Counter(lines).items() if c > 1 and line.strip(ASCII_SPACE))


def base_features(text: str, memo: WordMemory) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    return (
        len(words),
        len(text) - sum(map(text.count, ASCII_SPACE)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(words, memo),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def trusted_ids(documents: DataFrame, labels: DataFrame, most: int = TRUSTED) -> np.ndarray:
    """Sorted ids of trusted labelled rows, of each language slot at most `most`, those with the least hashes."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    own = (F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary")) % SLOTS).cast("int")
    placed = cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("own")).join(good, "doc_id").distinct().withColumn("hash", F.xxhash64("doc_id")))
    reach = F.lit(2**63 - 1)  # hashes up to it: all of a small slot, a little more than `most` of a large one
    for r in placed.groupBy("own").count().collect():  # a row a slot
        share = (most + 8 * most**0.5 + 8) / r["count"]
        if share < 1:
            reach = F.when(F.col("own") == r["own"], F.lit(int(share * 2**64) - 2**63)).otherwise(reach)
    held: dict[int, list[tuple[int, int]]] = {}
    for r in placed.where(F.col("hash") <= reach).collect():
        held.setdefault(r["own"], []).append((r["hash"], r["doc_id"]))
    return np.array(sorted({i for found in held.values() for _, i in sorted(found)[:most]}), np.int64)


def are_in(ids: pa.Array, known: np.ndarray) -> np.ndarray:
    """Which ids are among the sorted known ones; null is not."""
    if not len(known):
        return np.zeros(len(ids), bool)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return (known[np.minimum(np.searchsorted(known, numbers), len(known) - 1)] == numbers) & ids.is_valid().to_numpy(zero_copy_only=False)


def fit(documents: DataFrame, labels: DataFrame, most: int = TRUSTED) -> np.ndarray:
    """The log ratio of each bucket, from one scan of all documents."""
    spark = documents.sparkSession
    trusted = spark.sparkContext.broadcast(trusted_ids(documents, labels, most))

    def count(batches):
        raw, target = np.zeros(SLOTS * BUCKETS, np.int64), np.zeros(SLOTS * BUCKETS, np.int64)
        for batch in batches:
            held: dict[int, list[np.ndarray]] = {}
            for good, lang, text in zip(are_in(batch.column("doc_id"), trusted.value), batch.column("lang").to_pylist(), texts(batch), strict=True):
                codes, at = gram_buckets(text.encode("utf-8", "surrogatepass")), slot(lang)
                if good:
                    target[at : at + BUCKETS] += np.bincount(codes, minlength=BUCKETS)
                held.setdefault(at, []).append(codes)
            for at, codes in held.items():
                raw[at : at + BUCKETS] += np.bincount(np.concatenate(codes), minlength=BUCKETS)
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(raw[there]), pa.array(target[there])], ["bucket", "n_raw", "n_target"])

    counted = (
        in_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"), count, "bucket long, n_raw long, n_target long")
        .groupBy("bucket").agg(F.sum("n_raw"), F.sum("n_target")).toPandas()  # SLOTS * BUCKETS rows at most
    )
    raw, target = np.zeros(SLOTS * BUCKETS), np.zeros(SLOTS * BUCKETS)
    raw[counted.iloc[:, 0]], target[counted.iloc[:, 0]] = counted.iloc[:, 1], counted.iloc[:, 2]
    return log_ratios(raw.reshape(SLOTS, BUCKETS), target.reshape(SLOTS, BUCKETS)).ravel().astype(np.float32)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By slot and bucket. The prior of a bucket is its share of the slot's raw counts: without evidence the ratio is 0."""
    share = (raw + 0.5) / (raw + 0.5).sum(1, keepdims=True)
    smoothed = (target + PRIOR * share * BUCKETS) / (target.sum(1, keepdims=True) + PRIOR * BUCKETS)
    return np.log(smoothed) - np.log(share)


def score(raw: bytes, lang: str | None, ratios: np.ndarray) -> float:
    codes, at = gram_buckets(raw), slot(lang)
    return float(ratios[at : at + BUCKETS][codes].mean(dtype=np.float64)) if len(codes) else 0.0


def stretch(lang: str | None, ratios: np.ndarray) -> float:
    """DEPTH by the least ratio of the language's slot, 1 at least; 1 without trusted documents, where all ratios are 0 but for rounding."""
    at = slot(lang)
    depth = -float(ratios[at : at + BUCKETS].min())
    return DEPTH / depth if 1e-6 < depth < DEPTH else 1.0


def judge(text: str, lang: str | None, ratios: np.ndarray, memo: WordMemory, threshold: float = THRESHOLD) -> tuple:
    """The base features, base_failed, score and verdict of a text."""
    features = base_features(text, memo)
    failed = base_failed(features[0], features[4])
    s = score(text.encode("utf-8", "surrogatepass"), lang, ratios) * stretch(lang, ratios)
    return *features, failed, s, not failed and s >= threshold


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row of features and the verdict for each row of documents."""
    ratios = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def each(batch: pa.RecordBatch, memo: WordMemory) -> dict:
        judged = list(zip(*(judge(t, g, ratios.value, memo, threshold) for t, g in zip(texts(batch), batch.column("lang").to_pylist(), strict=True)), strict=True))
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        return {"doc_id": batch.column("doc_id")} | {n: pa.array(v, k) for n, v, k in zip(names, judged, types, strict=True)}

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return arrow_map(narrow, "doc_id long, " + COLUMNS, each, word_hashes)


def keep_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are kept, all their columns as they were."""
    ratios = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def keep(batches):
        memo = word_hashes()
        for batch in batches:
            yield batch.filter(pa.array([judge(t, g, ratios.value, memo, threshold)[-1] for t, g in zip(texts(batch), batch.column("lang").to_pylist(), strict=True)], pa.bool_()))

    return in_arrow(documents, keep, documents.schema)
