"""Token counts kept by deltas.

A change of a document is an insert, a delete or a revised count; it becomes a signed delta of documents and tokens under
(source, lang, tokenizer version). Deltas are summed within a batch before anything moves. A batch is committed in two steps:
its summed deltas are written to a folder of their own under data/, then a small file commits/<batch id> that names the folder
comes to be, whole and at once, which fails if it is there. Only folders that are named count, so a batch is there wholly or not
at all, and a batch whose id is already there is left alone: a retried or replayed commit changes nothing, and of writers that
race for one id a single one has committed.

Totals are the sum over committed batches. compact() folds batches: it writes their sum, then one file folds/<number> that
names the sum and, as ranges, the ids it stands for. A crash before that file leaves all as it was; folders that nothing names
are swept by vacuum(). Ids of folded batches stay known by their files' names, which are not opened again.

Null text counts no tokens and one document; null source or lang is a key of its own. Repeated rows count as often as they
are there. Keys whose documents all went have zero counts, and maintained_counts() doesn't list them. An empty batch commits
as well, so its id is known.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from bisect import bisect_right
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import arrow_map, fresh_dir, texts, written
from leafmill.sources.shared import create_complete, names_in, read_small, remove

KEYS = ["source", "lang", "tokenizer"]
STATE = "source string, lang string, tokenizer string, docs long, tokens long"

_LOADED: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str):
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _LOADED[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def count_tokens(documents: DataFrame, tokenizers: dict[str, tuple[str, str]]) -> DataFrame:
    """source, lang, n_words and for each version a column n_<version>: tokens of each whole text. tokenizers: version -> (rank file, pattern)."""

    def each(batch: pa.RecordBatch) -> dict:
        whole = texts(batch)
        out = {"source": batch.column("source"), "lang": batch.column("lang"), "n_words": pa.array([len(t.encode("utf-8", "surrogatepass").split()) for t in whole], pa.int64())}
        for version, (path, pattern) in tokenizers.items():
            encode = encoder(path, pattern).encode_ordinary
            out[f"n_{version}"] = pa.array([len(encode(t)) for t in whole], pa.int64())
        return out

    schema = "source string, lang string, n_words long" + "".join(f", n_{v} long" for v in tokenizers)
    return arrow_map(documents.selectExpr("cast(source as string) as source", "cast(lang as string) as lang", "text"), schema, each)


def signed(changes: DataFrame) -> DataFrame:
    """Deltas of changes (op, source, lang, tokenizer, tokens, old_tokens): an insert adds, a delete takes away, a revision adds the difference.
    Null counts read as 0; other ops fail."""
    op, new, old = F.col("op"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(unknown.cast("int"))
    tokens = F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old)
    return changes.select(*KEYS, docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


#: a commit's file holds the name of its folder and a line's end, so its length tells whether it is whole
NAME = 32


def _listed(spark: SparkSession, folder: str) -> dict[str, int]:
    """Name and length of the files of a folder; none of them is opened."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(path)} if fs.exists(path) else {}


def _length(spark: SparkSession, file: str) -> int | None:
    """A file's length; null if it isn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(path).getLen() if fs.exists(path) else None


def _create(spark: SparkSession, file: str, content: str, whole: int | None = None) -> bool:
    """Creates a small file at once, with all of its content; False if there is one. A file that is shorter than `whole` is left
    of something that broke off; it stays, and the next name, with ~1 and so on, is tried. So nothing is ever taken away that
    another writer may just have made, and of several writers exactly one gets True."""
    for turn in range(1000):
        name = f"{file}~{turn}" if turn else file
        if create_complete(spark, name, content + "\n"):
            return True
        if whole is None or (_length(spark, name) or 0) >= whole:
            return False
    raise RuntimeError(f"{file}: a thousand files that broke off")


def _commits(spark: SparkSession, state: str) -> dict[str, str]:
    """Batch ids and names of the files of whole commits, from a listing alone."""
    return {n.split("~")[0]: n for n, length in _listed(spark, f"{state}/commits").items() if length > NAME and not n.startswith(("_", "."))}


def ranges(ids: list[str]) -> list[list]:
    """Ids in short: those that end in successive numbers of one width are a range (prefix, width, first, last); others are
    ranges of their own with width 0."""
    found: list[list] = []
    split = lambda i: (re.fullmatch(r"(.*?)(\d{0,18})", i, re.DOTALL)).groups()
    for prefix, width, n in sorted((p, len(d), int(d or 0)) for p, d in map(split, ids)):
        if found and found[-1][:2] == [prefix, width] and width and found[-1][3] == n - 1:
            found[-1][3] = n
        else:
            found.append([prefix, width, n, n])
    return found


def in_ranges(known: list[list]) -> Callable[[str], bool]:
    """Whether an id is in one of the ranges, by a search in their order."""
    starts = [tuple(r[:3]) for r in known]

    def inside(i: str) -> bool:
        prefix, digits = re.fullmatch(r"(.*?)(\d{0,18})", i, re.DOTALL).groups()
        own = (prefix, len(digits), int(digits or 0))
        k = bisect_right(starts, own) - 1
        return k >= 0 and starts[k][:2] == own[:2] and own[2] <= known[k][3]

    return inside


def _folded(spark: SparkSession, state: str) -> dict:
    """The last whole fold: the folder of its sum and the ids that are in it."""
    for name in sorted((n for n in _listed(spark, f"{state}/folds") if n.isdigit()), reverse=True):
        text = read_small(spark, f"{state}/folds/{name}")
        if text.endswith("\n"):
            return json.loads(text)
    return {"data": None, "ids": []}


def committed(spark: SparkSession, state: str) -> list[str]:
    """Ids of the committed batches."""
    return sorted(_commits(spark, state))


def is_committed(spark: SparkSession, state: str, batch_id: str) -> bool:
    """Looks for the batch's own file alone, however many others there are."""
    for turn in range(1000):
        length = _length(spark, f"{state}/commits/{batch_id}~{turn}" if turn else f"{state}/commits/{batch_id}")
        if length is None or length > NAME:
            return length is not None
    return False


def commit(spark: SparkSession, state: str, batch_id: str, deltas: DataFrame) -> bool:
    """Commits the summed deltas under the id; False, and nothing changed, if that batch is there already. What it does on the
    driver doesn't grow with the batches there are."""
    if not batch_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"batch ids are letters, digits, - and _: {batch_id!r}")
    if is_committed(spark, state, batch_id):
        return False
    return _create(spark, f"{state}/commits/{batch_id}", _written_sum(deltas, state), NAME + 1)


def _written_sum(deltas: DataFrame, state: str) -> str:
    """The folder under data/ that the summed deltas, a row a key, were written to."""
    name = uuid.uuid4().hex
    summed(deltas).coalesce(1).write.parquet(f"{state}/data/{name}")
    return name


def _counting(spark: SparkSession, state: str) -> list[str]:
    """The folders whose sum are the totals. Only files of commits that aren't folded are opened."""
    fold = _folded(spark, state)
    folded = in_ranges(fold["ids"])
    own = [read_small(spark, f"{state}/commits/{name}").strip() for batch, name in _commits(spark, state).items() if not folded(batch)]
    return ([fold["data"]] if fold["data"] else []) + sorted(own)


def _deltas(spark: SparkSession, state: str) -> DataFrame:
    folders = _counting(spark, state)
    return spark.read.schema(STATE).parquet(*(f"{state}/data/{f}" for f in folders)) if folders else spark.createDataFrame([], STATE)


def totals(spark: SparkSession, state: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
    return summed(_deltas(spark, state)).select(*KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


#: the version under which documents are counted by words until a tokenizer has seen them
PROVISIONAL = "words"


def maintained_counts(documents: DataFrame, tokenizers: dict[str, tuple[str, str]], state: str | None = None) -> DataFrame:
    """Keeps the counts of all documents in three batches and returns the totals: `load` inserts them under the provisional
    version with their words, `migrate` deletes them there and inserts them under each tokenizer's version with the same
    count, and `revise` puts the token counts in its place. Run again over the same state it changes nothing."""
    spark = documents.sparkSession
    state = state or fresh_dir(spark, "token-counts")
    if not {"load", "migrate", "revise"} <= set(committed(spark, state)):
        counts = written(count_tokens(documents, tokenizers), "document-tokens")

        def change(op: str, version: str, tokens: str, old: str | None = None) -> DataFrame:
            return counts.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), F.col(tokens).alias("tokens"), (F.col(old) if old else F.lit(0)).cast("long").alias("old_tokens"))

        commit(spark, state, "load", signed(change("insert", PROVISIONAL, "n_words")))
        moves = [change("delete", PROVISIONAL, "n_words"), *(change("insert", v, "n_words") for v in tokenizers)]
        commit(spark, state, "migrate", signed(reduce(DataFrame.unionByName, moves)))
        commit(spark, state, "revise", signed(reduce(DataFrame.unionByName, [change("revise", v, f"n_{v}", "n_words") for v in tokenizers])))
    return totals(spark, state).where("n_docs <> 0 or n_tokens <> 0")


def compact(spark: SparkSession, state: str) -> None:
    """Folds all committed batches into one sum. A batch that is committed meanwhile isn't in it and counts by itself; of two
    folds at once one counts."""
    ids = committed(spark, state)
    last = max((n for n in _listed(spark, f"{state}/folds") if n.isdigit()), default="0")
    fold, folded = _folded(spark, state), set(ids)
    known = in_ranges(fold["ids"])
    folders = ([fold["data"]] if fold["data"] else []) + [read_small(spark, f"{state}/commits/{name}").strip() for b, name in _commits(spark, state).items() if b in folded and not known(b)]
    sums = spark.read.schema(STATE).parquet(*(f"{state}/data/{f}" for f in folders)) if folders else spark.createDataFrame([], STATE)
    _create(spark, f"{state}/folds/{int(last) + 1:010d}", json.dumps({"data": _written_sum(sums, state), "ids": ranges(ids)}))


def vacuum(spark: SparkSession, state: str) -> None:
    """Removes folders that the totals don't need: folded batches, earlier folds and what broken commits have left. For the
    single writer, when nobody reads older totals."""
    needed = set(_counting(spark, state))
    for folder in names_in(spark, f"{state}/data"):
        if folder not in needed:
            remove(spark, f"{state}/data/{folder}")
