"""Several tables that change together, and streams that change them once.

A table is a list of segments, each a folder of Parquet that never changes. A manifest, one small file per version, names the
segments of all tables; the greatest number is the present. A commit writes its segments, and then creates the next manifest,
which fails if somebody else has: so a reader sees all of a commit or nothing of it, also when the writer dies between two steps,
and a writer that started from an older state learns of it (Conflict) and may try again from the present one (transact()).
Segments no manifest names are swept by vacuum().

A keyed table may hold a key in several segments; the latest row counts (latest()). So a small change writes a small segment,
and compact() folds them when they have become many. Manifests say which batch of which stream came last: a batch that is
replayed after a failure changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.shared import create_complete, names_in, read_small, remove


class Conflict(Exception):
    """Somebody else has committed since the state that a change was made from."""


@dataclass(frozen=True)
class Snapshot:
    """The tables as one manifest has them."""

    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def snapshot(self, number: int | None = None) -> Snapshot:
        if number is None:
            number = max(self.numbers(), default=0)
        return Snapshot(**json.loads(read_small(self.spark, self.manifest(number)))) if number else Snapshot()

    def numbers(self) -> list[int]:
        return [int(n) for n in names_in(self.spark, f"{self.path}/_manifests") if n.isdigit()]

    def manifest(self, number: int) -> str:
        return f"{self.path}/_manifests/{number:012d}"

    def read(self, table: str, at: Snapshot | None = None) -> DataFrame:
        """All rows of a table's segments."""
        at = at or self.snapshot()
        reader = self.spark.read.schema(at.schemas[table])
        folders = [f"{self.path}/{s}" for s in at.tables[table]]
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], at.schemas[table])

    def latest(self, table: str, keys: list[str], order: str, at: Snapshot | None = None) -> DataFrame:
        """Of each key the row that is last by `order`, over all segments."""
        rows = self.read(table, at)
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")

    def written(self, table: str, rows: DataFrame) -> str:
        segment = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{segment}")
        return segment

    def commit(self, base: Snapshot, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None) -> Snapshot:
        """The next version: tables that are replaced as a whole, and tables that get one more segment. Raises Conflict if `base`
        isn't the present any more."""
        tables, schemas = {t: list(s) for t, s in base.tables.items()}, dict(base.schemas)
        for t, rows in (replaced or {}).items():
            tables[t], schemas[t] = [self.written(t, rows)], _ddl(rows)
        for t, rows in (appended or {}).items():
            tables[t] = [*tables.get(t, []), self.written(t, rows)]
            schemas.setdefault(t, _ddl(rows))
        new = Snapshot(base.number + 1, tables, schemas, base.batches | dict([batch] if batch else []))
        if not create_complete(self.spark, self.manifest(new.number), json.dumps(new.__dict__)):
            raise Conflict(f"version {new.number} of {self.path} is somebody else's")
        return new

    def transact(self, change: Callable[[Snapshot], dict], tries: int = 10) -> Snapshot:
        """change(snapshot) gives what commit() takes; it is asked again, with the present state, if another commit came first."""
        for left in range(tries - 1, -1, -1):
            base = self.snapshot()
            try:
                return self.commit(base, **change(base))
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def compact(self, table: str, keys: list[str], order: str) -> Snapshot:
        """Folds a keyed table's segments into one."""
        return self.transact(lambda at: {"replaced": {table: self.latest(table, keys, order, at)}})

    def vacuum(self, keep: int = 2) -> None:
        """Removes manifests before the last `keep`, and segments that those don't name. Not beside running commits: what one has
        written and not yet named would go."""
        numbers = sorted(self.numbers())
        named = {s for n in numbers[-keep:] for segments in self.snapshot(n).tables.values() for s in segments}
        for n in numbers[:-keep]:
            remove(self.spark, self.manifest(n))
        for t in names_in(self.spark, self.path):
            for s in names_in(self.spark, f"{self.path}/{t}") if t != "_manifests" else []:
                if f"{t}/{s}" not in named:
                    remove(self.spark, f"{self.path}/{t}/{s}")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


# ── streams into a store ──


def each_batch_once(store: Store, stream: str, change: Callable[[Snapshot, DataFrame], dict]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: change(snapshot, rows) gives what commit() takes, and the commit names the batch; one that is named
    already is passed over."""

    def take(rows: DataFrame, number: int) -> None:
        def once(at: Snapshot) -> dict:
            if at.batches.get(stream, -1) >= number:
                raise _Done
            return change(at, rows) | {"batch": (stream, number)}

        try:
            store.transact(once)
        except _Done:
            pass

    return take


class _Done(Exception):
    pass


def keep_latest(store: Store, table: str, keys: list[str], order: str) -> Callable[[Snapshot, DataFrame], dict]:
    """Of each key of a batch the last row, as one more segment."""
    return lambda at, rows: {"appended": {table: rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")}}


def replay(store: Store, table: str, key: str, now: F.Column, seconds: int = 30) -> DataFrame:
    """What a client that asks now is sent at once: a key's latest event (ts), if it isn't older than the window."""
    return store.latest(table, [key], "ord").where(F.col("ts") >= now - F.expr(f"interval {seconds} seconds"))


def compare_and_set_batch(store: Store, table: str, verdicts: str) -> Callable[[Snapshot, DataFrame], dict]:
    """A batch of updates (key, ord, expected, value) against the versions that are stored (key, version, value, ord): one that
    expects the version it meets is taken and makes the next, any other is answered with 409 and what is there. New versions
    and verdicts are one commit."""
    from leafmill.operators.folds import folded

    def step(state: tuple, key: object, ord_: int, expected: int, new: str, stored: int, stored_value: str) -> tuple[tuple, tuple]:
        version, value = state if state else (stored, stored_value)
        ok = expected == version
        if ok:
            version, value = version + 1, new
        return (version, value), (key, ord_, 200 if ok else 409, version, value)

    def change(at: Snapshot, rows: DataFrame) -> dict:
        asked = rows.select("key", F.col("ord").cast("long").alias("ord"), F.col("expected").cast("long").alias("expected"), F.col("value").cast("string").alias("value"))
        if table in at.tables:
            # of the stored keys only those of the batch
            stored = store.read(table, at).join(asked.select("key").distinct(), "key", "left_semi")
            last = stored.groupBy("key").agg(F.max_by(F.struct("version", "value"), "version").alias("s"))
            asked = asked.join(last.select("key", F.col("s.version").alias("stored"), F.col("s.value").alias("stored_value")), "key", "left").withColumn("stored", F.coalesce("stored", F.lit(0).cast("long")))
        else:
            asked = asked.withColumn("stored", F.lit(0).cast("long")).withColumn("stored_value", F.lit(None).cast("string"))
        kind = rows.schema["key"].dataType.simpleString()
        judged = folded(asked, "key", ["ord"], lambda: None, step, f"key {kind}, ord long, status int, version long, value string")
        taken = judged.where("status = 200").groupBy("key").agg(F.max_by(F.struct("version", "value", "ord"), "version").alias("s")).select("key", "s.version", "s.value", "s.ord")
        return {"appended": {table: taken, verdicts: judged}}

    return change
