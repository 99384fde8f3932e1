"""The folder that driver and executors share, and tables in it that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session in one process (master local) gets a folder of its own; on a cluster
    that would be a folder a machine, so there it fails."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.sparkContext.setCheckpointDir(_OWN[key])
    return _OWN[key]


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/leafmill/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder: what several branches of a plan read is made once, and outlives an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The same as a table in the shared folder, for columns that are read apart from each other."""
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(df: DataFrame) -> list[tuple[str, int, int]]:
    """The files that a frame reads, with sizes and times."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    found = []
    for file in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append((file, status.getLen(), status.getModificationTime()))
    return found


def lots_of(df: DataFrame, megabytes: int = 8) -> int:
    """Into how many partitions a frame's rows are dealt, so that a task's share doesn't grow with the table: one for so many
    megabytes of the files it reads, and at least as many as the session has."""
    size = sum(f[1] for f in files_of(df))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (megabytes << 20)))


#: bytes of an Arrow batch between the JVM and Python; both sides hold several batches a task, and texts can be long
BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded bytes, whatever the length of the rows. Spark reads that bound from the session when the
    plan runs, so it is left set there; a value that the caller has set stays."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(key).rstrip("b") == str(64 << 20):  # Spark's own default
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(each, schema)


def create_complete(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file with all its content at once, if there is none of that name: it is written under a private name and
    given its own in one step that fails where the name is taken (a link on local disks, a rename without overwriting
    elsewhere). Of several writers one gets True, and nobody ever reads half a file."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    private = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_private-{uuid.uuid4().hex}")
    stream = fs.create(private, True)
    stream.write(text.encode())
    stream.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Path.of(jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(target), local(private))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(private, target, none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        if fs.exists(private):
            fs.delete(private, False)


def read_small(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder; none if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more. It goes by the driver's collections of
    garbage, of which an idle driver has none for half an hour."""
    spark.sparkContext._jvm.System.gc()
