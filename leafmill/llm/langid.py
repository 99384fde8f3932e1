"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability in it is the sum, over all ways
to cut the word into pieces, of the product of their probabilities; a forward pass over the word's places gives it. A text's
score in a language is the sum of its words' logarithms and of the language's share of the documents learnt from.

Words are runs of letters in lower case, with the vocabulary's mark of a word's start before them; runs of more than LONGEST
letters (scripts without spaces) go in parts of LONGEST. A letter that is no piece counts as the piece `unknown`.

Learning takes text and lang of documents that have a lang and whose crc32 of the decimal id mod 4 isn't 2 (a null id has 0): of
each language about SAMPLE documents, those with the least hashes; all, if it has fewer. Their words are counted by language in
Spark; ROUNDS of expectation and maximisation start from equal pieces: forward and backward passes give each piece's expected
count in each word, which are summed by language and piece. The model is a number a language and piece, 0.25 MB a language;
nothing else reaches the driver or is handed to the tasks. Counts are backed off to those of all languages together.

Scoring is one scan, no text moves. Words of equal length are one matrix, so the passes are array operations over many words at
once; a worker remembers the scores of words it has met, with a bound on bytes.

score is the probability of the predicted language given the text, under the model (so near 1 for all but short texts). Ties go
to the lesser name. Null texts and texts without a letter are `und` with score 0, and so are all if nothing could be learnt. lang,
source and doc_id are no inputs of a prediction: equal texts get equal results. Repeated rows count as often as they are there;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import WORD_BYTES, arrow_map, in_arrow, texts, written

LONGEST = 47
WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{LONGEST - 1}}}")
START = "▁"
#: documents of a language that are learnt from, about
SAMPLE = 5_000
ROUNDS = 3
#: added to the count of each piece of all languages together, and tokens that this distribution weighs in each language
PRIOR, BACKED = 0.1, 1000.0
#: a piece has at least this probability. Probabilities are multiplied by SCALE for each letter, which all ways to cut a word
#: share, so that words of LONGEST letters stay within what doubles hold (1e-288 to 1e144)
FLOOR, SCALE = 1e-9, 1000.0
#: bytes of words that a worker remembers with their scores before it starts anew, and numbers in a matrix of words
MEMO_BYTES, CELLS = 96_000_000, 1_000_000
UNDETERMINED = "und"


class Pieces:
    """The pieces of a sentencepiece model, found by 64-bit polynomial hashes of their code points."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.pieces = sorted({model.id_to_piece(i) for i in usual} - {""})
        self.longest = max(map(len, self.pieces))
        self.size = len(self.pieces) + 2  # with `absent`, whose probability is 0, and `unknown`
        self.absent, self.unknown = self.size - 2, self.size - 1
        self.lengths = np.array([*map(len, self.pieces), 1, 1])
        hashes = np.array([self.hashed(np.frombuffer(p.encode("utf-32-le"), "<u4")[None, :])[0] for p in self.pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    @staticmethod
    def hashed(codes: np.ndarray, so_far: np.ndarray | None = None) -> np.ndarray:
        """A hash of each row of code points, or of rows that go on."""
        h = np.zeros(len(codes), np.uint64) if so_far is None else so_far
        for column in codes.T:
            h = (h + column + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], self.absent)

    def lattice(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """Of words of one length: the piece from place i to place j of each, for all i < j that are a piece in some word."""
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)
        width, found = codes.shape[1], {}
        for i in range(width):
            h = None
            for j in range(i + 1, min(i + self.longest, width) + 1):
                h = self.hashed(codes[:, j - 1 : j], h)
                ids = self.ids(h)
                if j == i + 1:
                    ids[ids == self.absent] = self.unknown
                if (ids != self.absent).any():
                    found[i, j] = ids
        return found

    def scaled(self, probabilities: np.ndarray) -> np.ndarray:
        """Probabilities (a column a language) as the passes take them."""
        p = np.maximum(probabilities, FLOOR) * (SCALE ** self.lengths)[:, None]
        p[self.absent] = 0
        return p


def forward(lattice: dict[tuple[int, int], np.ndarray], width: int, of: np.ndarray) -> list[np.ndarray]:
    """For each place of the words, the sum over all ways to cut what is before it. of[ids] are the pieces' scaled probabilities."""
    sums: list = [None] * (width + 1)
    sums[0] = 1.0
    for i, j in sorted(lattice, key=lambda at: (at[1], at[0])):
        more = sums[i] * of[lattice[i, j]]
        sums[j] = more if sums[j] is None else sums[j] + more
    return sums


def by_length(words: list[str], columns: int) -> Iterator[tuple[int, list[int]]]:
    """Length and places of words of one length, in lots that make matrices of bounded size."""
    held: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        held.setdefault(len(w), []).append(k)
    for length, at in held.items():
        lot = max(1, CELLS // ((length + 2) * max(columns, 1)))
        for k in range(0, len(at), lot):
            yield length, at[k : k + lot]


def word_logs(words: list[str], pieces: Pieces, scaled: np.ndarray) -> np.ndarray:
    """The logarithm of each word's probability in each language."""
    out = np.empty((len(words), scaled.shape[1]))
    for length, at in by_length(words, scaled.shape[1]):
        lattice = pieces.lattice([words[k] for k in at])
        out[at] = np.log(forward(lattice, length + 1, scaled)[-1]) - (length + 1) * np.log(SCALE)
    return out


def expected(words: list[str], lang: np.ndarray, n: np.ndarray, pieces: Pieces, scaled: np.ndarray) -> np.ndarray:
    """The expected number of each piece (a row) in each language (a column), over words that occur n times in the language."""
    out = np.zeros(scaled.size)
    flat, languages = scaled.ravel(), scaled.shape[1]
    for length, at in by_length(words, 4):
        lattice, own, width = pieces.lattice([words[k] for k in at]), lang[at], length + 1
        cells = {at: ids * languages + own for at, ids in lattice.items()}
        before = forward(cells, width, flat)
        after: list = [None] * width + [n[at] / before[-1]]
        for i, j in sorted(cells, reverse=True):
            more = after[j] * flat[cells[i, j]]
            out += np.bincount(cells[i, j], before[i] * more, scaled.size)
            after[i] = more if after[i] is None else after[i] + more
    return out.reshape(scaled.shape)


def probabilities(counts: np.ndarray, absent: int) -> np.ndarray:
    """Of each piece (a row) in each language (a column), from expected counts."""
    together = counts.sum(1, keepdims=True) + PRIOR
    together[absent] = 0
    together /= together.sum()
    return (counts + BACKED * together) / (counts.sum(0) + BACKED)


def word_counts(text: str) -> Counter:
    """The words of a whole text; of long ones never all at once in a list."""
    if len(text) < 1 << 20:
        return Counter(WORD.findall(text.lower()))
    found, matches = Counter(), (m[0].lower() for m in WORD.finditer(text))
    while lot := list(islice(matches, 1 << 16)):
        found.update(lot)
    return found


def remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % 4


def learnt_words(documents: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[str, int]]:
    """lang, word, n over the documents learnt from, and all labelled documents' numbers by language."""
    labelled = documents.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("hash"), remainder().alias("left")).where("lang is not null and left <> 2")
    numbers = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    reach = F.lit(2**63 - 1)
    for lang, count in numbers.items():
        if count > sample:
            reach = F.when(F.col("lang") == lang, F.lit(int(sample / count * 2**64) - 2**63)).otherwise(reach)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                held.setdefault(lang, Counter()).update(word_counts(text))
            for lang, words in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    counted = in_arrow(labelled.where(F.col("hash") <= reach).select("lang", "text"), count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), numbers


class Model:
    """Languages, their shares of the documents, and the probabilities of pieces (rows) in them (columns)."""

    def __init__(self, path: str, languages: list[str], shares: np.ndarray, pieces: np.ndarray):
        self.path, self.languages, self.shares, self.pieces = path, languages, shares, pieces


def fit(documents: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    spark = documents.sparkSession
    words, numbers = learnt_words(documents, sample)
    languages = sorted(numbers)
    number = {g: k for k, g in enumerate(languages)}
    pieces = worker_pieces(path)
    model = np.full((pieces.size, len(languages)), 1 / pieces.size)
    shares = np.array([numbers[g] for g in languages], float)
    if not languages:
        return Model(path, [], shares, model)
    words = written(words, "words")
    for _ in range(rounds):
        handed = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], handed=handed) -> Iterator[pa.RecordBatch]:
            own = worker_pieces(path)
            scaled, total = own.scaled(handed.value), np.zeros(handed.value.shape)
            for batch in batches:
                lang = np.array([number[g] for g in batch.column("lang").to_pylist()], int)
                total += expected(batch.column("word").to_pylist(), lang, batch.column("n").to_numpy().astype(float), own, scaled)
            there = np.argwhere(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(there[:, 0], pa.int32()), pa.array(there[:, 1], pa.int32()), pa.array(total[tuple(there.T)])], ["piece", "lang", "n"])

        # at most a row a language and piece; sums of doubles in whatever order they come differ in the last digits only
        found = in_arrow(words, expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(model.shape)
        counts[found["piece"], found["lang"]] = found["n"]
        model = probabilities(counts, pieces.absent)
        handed.unpersist()
    return Model(path, languages, shares / shares.sum(), model)


_PIECES: dict[str, Pieces] = {}


def worker_pieces(path: str) -> Pieces:
    """Built once in each process."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


class Scorer:
    """Scores of texts, with the words met so far: a row of a matrix each."""

    def __init__(self, model: Model):
        self.pieces, self.model = worker_pieces(model.path), model
        self.scaled = self.pieces.scaled(model.pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.logs, self.held = np.empty((1024, len(self.model.languages))), 0

    def learn(self, words: set[str]) -> None:
        if self.held > MEMO_BYTES:
            self.forget()
        new = sorted(words.difference(self.known))
        if not new:
            return
        start, end = len(self.known), len(self.known) + len(new)
        if end > len(self.logs):
            grown = np.empty((max(end, 2 * len(self.logs)), self.logs.shape[1]))
            grown[:start] = self.logs[:start]
            self.logs = grown
        self.logs[start:end] = word_logs(new, self.pieces, self.scaled)
        self.known.update(zip(new, range(start, end), strict=True))
        self.held += sum(map(len, new)) + len(new) * (WORD_BYTES + 8 * self.logs.shape[1])

    def predict(self, batch: list[str]) -> list[tuple[str, float]]:
        counted = [word_counts(t) for t in batch] if self.model.languages else [Counter()] * len(batch)
        self.learn(set().union(*counted))
        return [self.best(c) for c in counted]

    def best(self, words: Counter) -> tuple[str, float]:
        if not words:
            return UNDETERMINED, 0.0
        # in the words' order, so that equal texts get equal sums
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        logs = np.log(self.model.shares) + np.fromiter(words.values(), np.float64, len(words)) @ self.logs[rows]
        k = int(logs.argmax())
        return self.model.languages[k], float(1 / np.exp(logs - logs[k]).sum())


def language_id(documents: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """A row of doc_id, held_out, lang_pred and score for each row of documents."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, path, sample, rounds))

    def each(batch: pa.RecordBatch, scorer: Scorer) -> dict:
        lang, score = zip(*scorer.predict(texts(batch)), strict=True)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder() == 2).alias("held_out"), "text")
    return arrow_map(narrow, "doc_id long, held_out boolean, lang_pred string, score double", each, lambda: Scorer(model.value))
