"""What the training-data operators share: tables, shared folders, Arrow helpers, text conventions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar, Token
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, [\x20\x09-\x0D]; bytes.split() and bytes.strip() use exactly this set.
ASCII_SPACE = " \t\n\x0b\x0c\r"

_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process
    (master local) gets a folder of its own; on a cluster that would be a folder a machine, so there it fails."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _FALLBACK:
        _FALLBACK[key] = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[key])
    return _FALLBACK[key]


#: the folder, below the shared one, that the running query writes its tables to
_RUN: ContextVar[str] = ContextVar("run", default="leafmill")
_RUNS: dict[tuple[str, str], list[str]] = {}


def query_run(spark: SparkSession, query: str) -> Token:
    """From now on written() uses a folder of this run's own. What runs of the query before the last one have written goes;
    the last one's result may not have been read yet."""
    runs = _RUNS.setdefault((spark.sparkContext.applicationId, query), [])
    while len(runs) > 1:
        remove(spark, f"{shared_dir(spark)}/{runs.pop(0)}")
    runs.append(f"leafmill/{query}-{uuid.uuid4().hex}")
    return _RUN.set(runs[-1])


def in_own_run(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the tables it writes in a folder of its run."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = query_run(spark, query.__name__)
        try:
            return query(spark, sf_dir)
        finally:
            _RUN.reset(token)

    return run


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{_RUN.get()}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder; a lost executor can't take it along."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all tables that written() has left in the shared folder; for when no result that reads them is needed any more."""
    remove(spark, f"{shared_dir(spark)}/leafmill")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, for narrow tables of iterative steps."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: bytes of an Arrow batch between the JVM and Python; both sides hold several batches a task, and texts can be long
BATCH_BYTES = 8 * 1024 * 1024


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded size, whatever the length of the rows. Spark reads that bound from the session when
    the plan runs, so it is left set there; a value that the caller has set stays."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if spark.conf.get(key).rstrip("b") == str(64 * 1024 * 1024):  # Spark's own default; a setting of the caller's stays
        spark.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, schema: str, each: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], setup: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow where `each` turns a batch into columns by name; setup() runs once a task and its value goes along."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = each(batch, state) if setup else each(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return in_arrow(df, run, schema)


class WordMemory:
    """Values of words that a task has met, with a bound on bytes: text without spaces has words as long as paragraphs.
    `known` is a plain dict, which set.difference() asks for each word; of any other mapping it would walk all of it."""

    def __init__(self, most: int, value: Callable[[bytes], object]):
        self.known: dict = {}
        self.most, self.value, self.held = most, value, 0

    def learn(self, words: set) -> dict:
        """What is known, with all these words; starts anew if memory is full."""
        if self.held > self.most:
            self.known, self.held = {}, 0
        for w in words.difference(self.known):
            self.known[w] = v = self.value(w)
            self.held += WORD_BYTES + len(w) + (len(v) if isinstance(v, bytes) else 0)
        return self.known


#: what an entry of a dict holds besides its characters
WORD_BYTES = 150


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts of a batch; null reads as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def document_key(column: str = "doc_id") -> F.Column:
    """A null id sorts after all others and stands for one document of its own."""
    return F.coalesce(F.col(column), F.lit(2**63 - 1))


def _crc_step() -> str:
    """A byte b into the checksum c, four bits at a time, in SQL, which has no CRC-32."""
    entries = list(range(16))
    for _ in range(4):
        entries = [n >> 1 ^ (0xEDB88320 if n & 1 else 0) for n in entries]
    half = lambda c, b: f"xor({c} >> 4, list_extract({entries}::ubigint[], (xor({c}, {b}) & 15)::bigint + 1))"
    return half(half("c", "b"), "(b >> 4)")


def sql_crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 form as a DuckDB expression."""
    start = f"list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex({text}), '..'), lambda s: ('0x' || s)::ubigint))"
    return f"xor(list_reduce({start}, lambda c, b: {_crc_step()}), 4294967295::ubigint)::bigint"
