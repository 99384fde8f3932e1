"""Mixture-controlled packing of whole corpora into sequences, by deficit round-robin over source queues.

1. Every whole text is tokenised once; the ids (with the end id) are written to the shared folder.
2. Each source is a queue, in the order of (hash chunk, doc_id, row). A round fills a window of WINDOW tokens: each queue
   gets credit in proportion to its target share and sends documents while its credit lasts; what is left, its deficit, is
   carried into the next round. After w rounds a queue with quantum q has had w*q credit and has sent exactly the documents
   whose running total is at most w*q, so a document's window is ceil(running total / q). That needs only running totals,
   made in two levels (chunks of a queue, documents of a chunk), so deficits carry across windows and partitions and no task
   sees a whole queue. A queue that runs dry hands its share to the others, whose quanta grow; so rounds are counted along
   the common clock of all queues, tokens sent over weight, on which each queue runs dry at its own time.
   The target is a mixture (source -> weight) or a temperature t: shares in proportion to (tokens of the source) ** t, 1 for
   the corpus's own mixture. Queues without a weight wait until the others are dry, then share by size.
3. Windows, and in them queues, and in them documents follow each other in one stream that is cut every 4096 tokens; only
   the last sequence of all is short. Offsets in the stream are again sums by level.

Null text is an empty document: the end id alone. A null source is the source ''. Repeated rows are packed as often as they
are there. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import arrow_map, written

SEQUENCE = 4096
WINDOW = 16 * SEQUENCE
#: chunks of a queue: so many at least, and a chunk has about so many rows at most
CHUNKS, CHUNK_ROWS = 1024, 50_000
#: windows whose documents are put in order together
SPAN = 64
FAN = 4096
END_ID = 2
#: exponent of the sources' sizes in the target mixture: below 1 small sources come in earlier than their share
TEMPERATURE = 0.7
#: bytes of words and of their ids that a task remembers before it starts anew; Arrow's and numpy's own, so the words may be many
MEMO_BYTES = 48_000_000
#: bytes of the texts that are encoded together
TOGETHER = 4_000_000


class WordIds:
    """Ids by a `tokenizers` file with word ends, lower case and NFC. Its patterns never match across ASCII white space, so
    words are encoded once and remembered, as Arrow and numpy arrays. Words of letters alone go to the tokenizer in one text
    and are told apart by the tokens that end a word; a full stop or comma after such a word is a pre-token of its own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same model for words that need no rewriting: lower case, NFC, one run of letters each
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.marks = [self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in ".,"]
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.stops, self.pool = np.zeros(1, np.int64), np.zeros(0, "<u4")

    @staticmethod
    def of_letters(words: pa.Array) -> pa.Array:
        """Which words are one run of letters that the tokenizer's rewriting leaves as they are."""
        return pc.and_(pc.utf8_is_alpha(words), pc.and_(pc.equal(pc.utf8_lower(words), words), pc.equal(pc.utf8_normalize(words, "NFC"), words)))

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and where each word's stop."""
        found = self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)
        return np.array([i for x in found for i in x.ids], "<u4"), np.cumsum([len(x.ids) for x in found], dtype=np.int64)

    def learn(self, new: pa.Array) -> np.ndarray:
        """Remembers words, and says at which place each one is."""
        letters = self.of_letters(new)
        plain, others = new.filter(letters), new.filter(pc.invert(letters))
        ids = np.zeros(0, "<u4")
        if len(plain):
            ids = np.array(self.letters.encode_batch_fast([" ".join(plain.to_pylist())], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(plain):
            ids, stops = self.encoded(plain)
        rest, rest_stops = self.encoded(others)
        is_plain = letters.to_numpy(zero_copy_only=False)
        places = np.empty(len(new), np.int64)
        places[is_plain], places[~is_plain] = len(self.known) + np.arange(len(plain)), len(self.known) + len(plain) + np.arange(len(others))
        self.known = pa.concat_arrays([self.known, plain, others])
        self.stops = np.concatenate((self.stops, len(self.pool) + stops, len(self.pool) + len(ids) + rest_stops))
        self.pool = np.concatenate((self.pool, ids, rest))
        return places

    def places(self, words: pa.Array) -> np.ndarray:
        """At which place each distinct word is remembered, those that are new after the tokenizer has seen them."""
        found = pc.index_in(words, self.known)
        if self.known.nbytes + self.pool.nbytes + self.stops.nbytes > MEMO_BYTES:
            self.forget()
            return self.learn(words)
        at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            at[at < 0] = self.learn(words.filter(pc.is_null(found)))
        return at

    def packed(self, whole: pa.Array, end: bytes = b"") -> list[bytes]:
        """Packed ids of each text. The tokenizer looks for its added tokens in the text as it is, before all else; texts
        that hold one's characters are left to it as a whole."""
        special = np.zeros(len(whole), bool)
        for token in self.added:
            special |= pc.match_substring(whole, token).to_numpy(zero_copy_only=False)
        if not special.any():
            return self.of_words(whole, end)
        out = iter(self.of_words(whole.filter(pa.array(~special)), end))
        return [array("I", self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids).tobytes() + end if s else next(out) for t, s in zip(whole, special, strict=True)]

    def of_words(self, whole: pa.Array, end: bytes) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, and the end. ASCII letters may be lower-cased first, the tokenizer
        does it anyway. Arrow's dictionary tells the distinct words; texts are put together from them by position."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(whole))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        # a word of letters with a stop or comma is looked up without it
        tail, core = pc.utf8_slice_codeunits(distinct, -1), pc.utf8_slice_codeunits(distinct, 0, -1)
        mark = pc.if_else(self.of_letters(core), pc.fill_null(pc.index_in(tail, pa.array([".", ","])), -1), -1).to_numpy(zero_copy_only=False)
        bases = pc.if_else(pa.array(mark >= 0), core, distinct).dictionary_encode()
        at = self.places(bases.dictionary)[bases.indices.to_numpy(zero_copy_only=False)]
        sizes = np.diff(self.stops)
        pool, stops = gathered(self.pool, self.stops[:-1], sizes[at] + (mark >= 0), at)
        for m, token in enumerate(self.marks):
            pool[stops[mark == m] - 1] = token
        lengths = np.diff(stops, prepend=0)
        which = coded.indices.to_numpy(zero_copy_only=False)
        tokens, stops = gathered(pool, stops - lengths, lengths[which], which)
        bounds = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))].tolist()
        return [tokens[a:b].tobytes() + end for a, b in zip(bounds, bounds[1:], strict=False)]


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the pool end to end, `lengths` from the starts of `which`; and where each one stops. A stretch may reach
    past the pool's end by what the caller writes over."""
    stops = np.cumsum(lengths)
    at = np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts[which] - (stops - lengths), lengths)
    return pool[np.minimum(at, max(0, len(pool) - 1))] if len(pool) else np.zeros(len(at), pool.dtype), stops


_LOADED: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def tokenised(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, source, n, ids (packed, with the end id); written, so a row keeps its number."""
    end = array("I", [end_id]).tobytes()

    def each(batch: pa.RecordBatch, words: WordIds) -> dict:
        whole = batch.column("text").fill_null("")
        sizes = np.cumsum(pc.binary_length(whole).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *np.flatnonzero(np.diff(sizes // TOGETHER)).tolist(), len(whole)]
        ids = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in words.packed(whole.slice(a, b - a), end)]
        return {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "n": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    ids = arrow_map(narrow, "doc_id long, source string, n long, ids binary", each, lambda: loaded(path))
    return written(ids.withColumn("row", F.monotonically_increasing_id()), "token-ids")


def weights(totals: dict[str, int], mixture: dict[str, float] | None = None, temperature: float = 1.0) -> dict[str, float]:
    """The weight of each queue that holds tokens; 0 for those that a mixture doesn't name."""
    return {s: float(mixture.get(s, 0)) if mixture else float(n) ** temperature for s, n in totals.items() if n}


def clock(totals: dict[str, int], weight: dict[str, float], window: int = WINDOW) -> tuple[dict[str, tuple[float, float]], list[tuple[float, float, float]]]:
    """For each queue its start on the common clock and its tokens a tick; and the clock's stretches (time, rounds before it,
    rounds a tick). A queue has sent (time - start) * tokens a tick; it runs dry when that is all it holds."""
    named = {s: w for s, w in weight.items() if w > 0}
    pace, stretches, time, rounds = {}, [], 0.0, 0.0
    for group in (named, {s: float(totals[s]) for s in weight if s not in named}):
        if not group:
            continue
        whole, start = sum(group.values()), time
        speed = {s: w / whole for s, w in group.items()}
        live = 1.0
        for s in sorted(group, key=lambda s: (totals[s] / speed[s], s)):
            pace[s] = start, speed[s]
            stretches.append((time, rounds, live / window))
            dry = start + totals[s] / speed[s]
            rounds += (dry - time) * live / window
            time, live = dry, max(live - speed[s], 0.0)
    return pace, stretches


def rounds_at(times: np.ndarray, stretches: list[tuple[float, float, float]]) -> np.ndarray:
    """The rounds that have begun, at least, by these times of the clock: the window of a document that is sent then."""
    if not len(times):
        return np.zeros(0, np.int64)
    start, before, rate = (np.array(x) for x in zip(*stretches, strict=True))
    at = np.searchsorted(start, times, "right") - 1
    found = before[at] + (times - start[at]) * rate[at]
    return np.maximum(np.ceil(found - 1e-9), 1).astype(np.int64)


def offsets(sums: DataFrame, key: str, amount: str, fan: int = FAN) -> DataFrame:
    """key, base: what all smaller keys add up to, in two levels; the upper one has a row for `fan` keys."""
    grouped = sums.withColumn("_g", F.floor(F.col(key) / fan))
    tops = grouped.groupBy("_g").agg(F.sum(amount).alias("_s"))
    above = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_g", F.coalesce(F.sum("_s").over(above), F.lit(0)).alias("_top"))
    below = Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return grouped.join(tops, "_g").select(key, (F.col("_top") + F.coalesce(F.sum(amount).over(below), F.lit(0))).alias("base"))


def placed(tokens: DataFrame, mixture: dict[str, float] | None = None, window: int = WINDOW, temperature: float = 1.0) -> DataFrame:
    """row, doc_id, n, window, at: a document's place in the stream."""
    held = tokens.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()  # a row a queue
    totals = {r["source"]: r["n"] for r in held}
    pace, stretches = clock(totals, weights(totals, mixture, temperature), window)
    n_chunks = max([CHUNKS, *(-(-r["rows"] // CHUNK_ROWS) for r in held)])
    docs = tokens.select("row", "doc_id", "source", "n").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "row"), F.lit(n_chunks)))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = docs.groupBy("source", "chunk").agg(F.sum("n").alias("s")).select("source", "chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    running = F.sum("n").over(Window.partitionBy("source", "chunk").orderBy("doc_id", "row"))
    queued = docs.withColumn("running", running).join(chunks, ["source", "chunk"]).withColumn("last", F.col("before") + F.col("running"))

    def in_window(batch: pa.RecordBatch) -> dict:
        at = np.array([pace[s] for s in batch.column("source").to_pylist()]).reshape(-1, 2)
        times = at[:, 0] + batch.column("last").to_numpy() / at[:, 1]
        return {c: batch.column(c) for c in ("row", "doc_id", "source", "n", "last")} | {"window": pa.array(rounds_at(times, stretches))}

    windows = arrow_map(queued.select("row", "doc_id", "source", "n", "last"), "row long, doc_id long, source string, n long, last long, window long", in_window)
    windows = windows.withColumn("span", F.floor(F.col("window") / SPAN))
    bases = offsets(windows.groupBy("span").agg(F.sum("n").alias("s")), "span", "s")
    within = F.sum("n").over(Window.partitionBy("span").orderBy("window", "source", "last")) - F.col("n")
    return windows.withColumn("within", within).join(bases, "span").select("row", "doc_id", "n", "window", (F.col("base") + F.col("within")).alias("at"))


def pack(documents: DataFrame, path: str, mixture: dict[str, float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW, end_id: int = END_ID, temperature: float = TEMPERATURE) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    tokens = tokenised(documents, path, end_id)
    places = placed(tokens, mixture, window, temperature).select("row", "at", "window")
    joined = places.join(tokens.select("row", "doc_id", "n", "ids"), "row")
    first, last = F.floor(F.col("at") / sequence), F.floor((F.col("at") + F.col("n") - 1) / sequence)

    def piece(s: F.Column) -> F.Column:
        start = F.greatest(s * sequence - F.col("at"), F.lit(0))
        length = F.least((s + 1) * sequence - F.col("at"), F.col("n")) - start
        crc = F.crc32(F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int")))
        return F.struct(start.alias("start"), length.alias("length"), crc.alias("ids_crc32"), s.alias("sequence_id"), (F.col("at") + start - s * sequence).alias("offset"))

    return joined.select("doc_id", F.col("n").alias("doc_tokens"), "window", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select(
        "doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", F.col("window").cast("long").alias("window")
    )
