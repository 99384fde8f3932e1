"""Full-text search: folded and Porter-stemmed tokens, postings, phrases and prefixes.

Tokens are runs of letters and digits, lower-cased, without diacritics, stemmed by the algorithm of M. F. Porter (1980).
A query's terms are parted by white space; each is a phrase of its own tokens, the last of which is a prefix of a stem; all
must match, each within one column of a document. A term without a token matches everything beside others, nothing alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.library import terms
from leafmill.sources.shared import files_of, fresh_dir, in_batches, lots_of, remove
from leafmill.sources.store import Snapshot, Store

#: what is stored: a row for each token of a document's column, with all places of it
GATHERED = "doc_id long, col string, token string, places array<int>"
#: places after which Python hands its rows over
HELD = 100_000
_TOKEN = re.compile(r"[^\W_]+")
#: runs of characters among which there are combining marks
_BEYOND = re.compile("[\u0300-\U0010ffff]+")


def fold(text: str) -> str:
    """Lower case without combining marks."""
    low = text.lower()
    return low if low.isascii() else _BEYOND.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), unicodedata.normalize("NFD", low))


_SOUNDS = str.maketrans({c: "v" if c in "aeiou" else "y" if c == "y" else "c" for c in map(chr, range(128))})


def _sounds(w: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = w.translate(_SOUNDS)
    while (i := out.find("y")) >= 0:
        out = f"{out[:i]}{'v' if i and out[i - 1] == 'c' else 'c'}{out[i + 1 :]}"
    return out


def _measure(w: str) -> int:
    return _sounds(w).count("vc")


def _has_vowel(w: str) -> bool:
    return "v" in _sounds(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _sounds(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return _sounds(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix tables of the published algorithm, steps 2, 3 and 4.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(word: str) -> str:
    """The stem of a folded token; tokens of one or two characters, or with other than Latin letters, are their own."""
    if len(word) < 3 or not word.isascii():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        hit = max((s for s, _ in table if w.endswith(s)), key=len, default=None)
        if hit and _measure(w[: -len(hit)]) > 0:
            w = w[: -len(hit)] + dict(table)[hit]
    hit = max((s for s in STEP4 if w.endswith(s)), key=len, default=None)
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[: -len(hit)].endswith(("s", "t"))):
        w = w[: -len(hit)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if _double(w) and w.endswith("l") and _measure(w) > 1:
        w = w[:-1]
    return w


def tokens(text: str) -> list[str]:
    return [porter(t) for t in _TOKEN.findall(fold(text))]


def gathered(articles: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """doc_id, col, token, places: the inverted index as a table, a row for each token of a document's column. Texts come in
    batches of bounded bytes, and rows are handed over as soon as there are many, so a task holds one document at most."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "col", "token", "places"])

    def each(batches):
        stems: dict[str, str] = {}
        for batch in batches:
            rows, held = [], 0
            ids = batch.column("doc_id").to_pylist()
            for c in columns:
                for doc, text in zip(ids, batch.column(c), strict=True):
                    places: dict[str, list[int]] = {}
                    for i, t in enumerate(_TOKEN.findall(fold(text.as_py() or ""))):
                        stem = stems.get(t)
                        if stem is None:
                            if len(stems) > 300_000:
                                stems.clear()
                            stem = stems[t] = porter(t)
                        places.setdefault(stem, []).append(i)
                        held += 1
                    rows += [(doc, c, t, at) for t, at in places.items()]
                    if held > HELD:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return in_batches(articles.select(F.col(id_column).cast("long").alias("doc_id"), *columns), each, GATHERED)


def postings(articles: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """doc_id, col, pos, token of every token of the columns."""
    return gathered(articles, columns, id_column).select("doc_id", "col", F.explode(F.col("places").cast("array<long>")).alias("pos"), "token")


def search(index: DataFrame, q: str) -> DataFrame:
    """doc_id of the documents that match, in postings or gathered ones. Only postings of the query's tokens are kept, then phrases
    are found by position; of a phrase of one token it counts that it is there. Gathered postings are dealt by document before
    their places are laid out, to as many partitions as the index is large."""
    phrases = [p for t in terms(q) if (p := tokens(t))]
    if not phrases:
        return index.select("doc_id").where(F.lit(False))
    parts = [(i, k, t, k == len(p) - 1) for i, p in enumerate(phrases) for k, t in enumerate(p)]
    wanted = reduce(or_, (F.col("token").startswith(t) if last else F.col("token") == t for _, _, t, last in parts))  # reaches the scan
    hits = F.array(*[F.struct(F.lit(i).alias("term"), F.lit(k).alias("k"), (F.col("token").startswith(t) if last else F.col("token") == t).alias("hit")) for i, k, t, last in parts])
    sizes = F.create_map(*[F.lit(x) for i, p in enumerate(phrases) for x in (i, len(p))])
    found = index.where(wanted)
    if "places" in index.columns:
        found = found.repartition(lots_of(index, 2), "doc_id")
    found = found.select("*", F.explode(F.filter(hits, lambda h: h["hit"])).alias("h")).withColumn("_one", sizes[F.col("h.term")] == 1)
    if "places" in index.columns:
        found = found.withColumn("pos", F.explode(F.when(F.col("_one"), F.slice("places", 1, 1)).otherwise(F.col("places"))))
    placed = found.select("doc_id", F.when(~F.col("_one"), F.col("col")).alias("col"), "h.term", "h.k", F.when(~F.col("_one"), F.col("pos") - F.col("h.k")).alias("start"))
    whole = placed.groupBy("doc_id", "col", "term", "start").agg(F.count_distinct("k").alias("n")).where(F.col("n") == sizes[F.col("term")])
    return whole.groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(phrases)).select("doc_id")


#: columns of an article that are indexed; the tags as the JSON they are stored as
INDEXED = ["title", "byline", "site_name", "text_content", "tags"]


def article_postings(articles: DataFrame) -> DataFrame:
    return gathered(articles.withColumn("tags", F.to_json("tags")), INDEXED)


def store(index: DataFrame, path: str) -> None:
    """Writes postings in the order of their tokens, so that a search reads the files and row groups of its own tokens alone.
    Ranges are by token and document, so a common token takes as many files as it needs, and as many as the library is large."""
    made, folder = as_made(index)
    in_token_order(made).write.option("parquet.block.size", 16 << 20).parquet(path)
    remove(index.sparkSession, folder)


def as_made(index: DataFrame) -> tuple[DataFrame, str]:
    """Postings as they come, and the folder they are in: ranges are found in rows before they are dealt by them, and no text is
    to be made into tokens twice."""
    folder = fresh_dir(index.sparkSession, "gathered")
    index.write.option("compression", "zstd").parquet(folder)
    return index.sparkSession.read.schema(index.schema).parquet(folder), folder


def in_token_order(index: DataFrame) -> DataFrame:
    return index.repartitionByRange(lots_of(index), "token", "doc_id").sortWithinPartitions("token", "doc_id")


_STORED: dict[tuple[str, str], tuple[tuple, str]] = {}


def state_of(table: DataFrame) -> tuple:
    """What tells one state of stored tables from another: their files, with sizes and times."""
    return tuple(files_of(table))


def stored_index(spark: SparkSession, name: str, articles: Callable[[], DataFrame]) -> DataFrame:
    """The session's stored index of a library: made once for a state of the library's files, then read by every search. Where
    the files have changed it is made anew, and the old postings go. A table that isn't read from files has one state; who has
    no table at hand (null) takes the index that is there."""
    key, table = (spark.sparkContext.applicationId, name), articles()
    state = state_of(table) if table is not None else _STORED[key][0]
    if key not in _STORED or _STORED[key][0] != state:
        path = fresh_dir(spark, "postings")
        store(article_postings(table), path)
        if key in _STORED:
            remove(spark, _STORED[key][1])
        _STORED[key] = state, path
    return spark.read.schema(GATHERED).parquet(_STORED[key][1])


class LivingIndex:
    """An index that follows its library: postings in segments, which searches merge as they read.

    A change writes the postings of the changed articles alone, as one more segment, and a tombstone a changed or deleted
    article; a posting counts if no tombstone of its article is younger. Both are one commit of the store, so a search sees a
    change wholly or not at all. Segments are in the order of tokens, so a search reads its own tokens' part of each.
    compact() folds segments that have become many, and tombstones go.
    """

    def __init__(self, tables: Store, columns: list[str] = INDEXED):
        self.tables, self.columns, self.folders = tables, columns, []

    def made(self, articles: DataFrame, number: int) -> DataFrame:
        found = gathered(articles.withColumn("tags", F.to_json("tags")) if "tags" in self.columns else articles, self.columns)
        rows, folder = as_made(found.withColumn("since", F.lit(number).cast("long")))
        self.folders.append(folder)
        return in_token_order(rows)

    def transact(self, change: Callable[[Snapshot], dict]) -> None:
        try:
            self.tables.transact(change)
        finally:
            while self.folders:
                remove(self.tables.spark, self.folders.pop())

    def create(self, articles: DataFrame) -> None:
        none = articles.sparkSession.createDataFrame([], "doc_id long, until long")
        self.transact(lambda at: {"replaced": {"postings": self.made(articles, at.number + 1), "gone": none}})

    def update(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Articles as they are now (id and the indexed columns), new ones among them, and ids of those that went (id)."""

        def change(at: Snapshot) -> dict:
            number = at.number + 1
            ids = [d.select(F.col("id").cast("long").alias("doc_id")) for d in (changed, deleted) if d is not None]
            gone = reduce(DataFrame.unionByName, ids).distinct().withColumn("until", F.lit(number).cast("long"))
            return {"appended": {"gone": gone} | ({"postings": self.made(changed, number)} if changed is not None else {})}

        self.transact(change)

    def read(self, at: Snapshot | None = None) -> DataFrame:
        """The gathered postings that count. A search's filter by tokens reaches the segments below the tombstones."""
        at = at or self.tables.snapshot()
        gone = self.tables.read("gone", at).groupBy("doc_id").agg(F.max("until").alias("until")).withColumnRenamed("doc_id", "_gone")
        rows = self.tables.read("postings", at)
        return rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("since") < F.col("until")), "left_anti").select("doc_id", "col", "token", "places")

    def search(self, q: str) -> DataFrame:
        return search(self.read(), q)

    def compact(self) -> None:
        """One segment in the order of tokens, no tombstones."""

        def change(at: Snapshot) -> dict:
            rows = self.read(at).withColumn("since", F.lit(at.number + 1).cast("long"))
            return {"replaced": {"postings": in_token_order(rows), "gone": rows.sparkSession.createDataFrame([], "doc_id long, until long")}}

        self.tables.transact(change)


def refreshed(index: DataFrame, changed: DataFrame, columns: list[str], id_column: str = "id") -> DataFrame:
    """The index after `changed` articles: their old postings go, their new ones come, all others stay."""
    stale = changed.select(F.col(id_column).alias("doc_id")).distinct()
    return index.join(stale, "doc_id", "left_anti").unionByName(postings(changed, columns, id_column))
