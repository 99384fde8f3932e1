"""Paged sources that settle: every page asked for comes out as a row, also one that failed, was refused or is too large.

`leafmill_pages` is a data source over numbered documents, <path>/page-<n>.json, with <path>/index.json that says how many there
are. Reading, pages are partitions of their own, or, where there are many, up to 64 are one, eight of which are asked for at a
time; a lost executor costs its pages alone. As a stream, a batch is what the index has more than at the last one. Writing, each row (page, body) becomes its document, and the
index comes last, so a reader never meets a page that isn't there yet. fetched_urls() asks for addresses that stand in a table.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

PAGE_BYTES = 8 * 1024 * 1024
SETTLED = "ok boolean, type string, body binary, error string"


def settled(url: str, most: int = PAGE_BYTES, seconds: float = 20) -> tuple[bool, str | None, bytes | None, str | None]:
    """ok, type, body and error of one address; never raises. A body over its cap isn't read to its end."""
    if not url or url.split(":")[0].lower() not in ("http", "https", "file"):
        return False, None, None, "refused"
    try:
        with urllib.request.urlopen(url, timeout=seconds) as reply:  # noqa: S310
            kind, body = reply.headers.get_content_type(), reply.read(most + 1)
    except urllib.error.HTTPError as e:
        return False, None, None, f"status {e.code}"
    except Exception as e:  # noqa: BLE001
        return False, None, None, "missing" if "No such file" in str(e) else type(e).__name__
    return (False, kind, None, "too large") if len(body) > most else (True, kind, body, None)


def fetched_urls(addresses: DataFrame, most: int = PAGE_BYTES, seconds: float = 20) -> DataFrame:
    """addresses (url and others) with what each gave: ok, type, body, error. One request a row, batches of bounded size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8):  # bodies may be large
                some = batch.slice(k, 8)
                ok, kind, body, error = zip(*(settled(u, most, seconds) for u in some.column("url").to_pylist()), strict=True)
                made = [pa.array(ok, pa.bool_()), pa.array(kind, pa.string()), pa.array(body, pa.binary()), pa.array(error, pa.string())]
                yield pa.RecordBatch.from_arrays([*some.columns, *made], [*some.schema.names, "ok", "type", "body", "error"])

    return addresses.mapInArrow(each, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in addresses.schema.fields) + ", " + SETTLED)


@dataclass
class Lot(InputPartition):
    first: int
    until: int


@dataclass
class Written(WriterCommitMessage):
    last: int


#: partitions up to which each page is one, most pages of a partition, and how many of them are asked for at a time
ALONE, LOT, AT_ONCE = 200, 64, 8


def lots(first: int, until: int) -> list[Lot]:
    """Pages dealt into partitions. A task costs more than a small page does, so many pages share one; never more than LOT do."""
    size = min(LOT, max(1, -(-(until - first) // ALONE)))
    return [Lot(n, min(n + size, until)) for n in range(first, until, size)]


class Pages(DataSource):
    """Options: path (a file:, http: or https: address), max_bytes, seconds."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_pages"

    def schema(self) -> str:
        return "page long, " + SETTLED

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PageWriter(self.options)


def page_count(path: str) -> int:
    ok, _, body, _ = settled(f"{path}/index.json")
    return int(json.loads(body)["pages"]) if ok else 0


class _Pages:
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.most, self.seconds = int(options.get("max_bytes", PAGE_BYTES)), float(options.get("seconds", 20))

    def read(self, partition: Lot | None) -> Iterator[tuple]:
        if partition is None:  # no pages: Spark asks once all the same
            return
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for k in range(partition.first, partition.until, AT_ONCE):  # bodies may be large: no more of them are held
                yield from pool.map(self.page, range(k, min(k + AT_ONCE, partition.until)))

    def page(self, number: int) -> tuple:
        return (number, *settled(f"{self.path}/page-{number}.json", self.most, self.seconds))


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Lot]:
        return lots(0, page_count(self.path))


class PageStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": page_count(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Lot]:
        return lots(start["pages"], end["pages"])

    def commit(self, end: dict) -> None:
        pass


class PageWriter(_Pages, DataSourceWriter):
    """To a folder that driver and executors share. A document is written under a private name and then put in its place, so a
    task that is tried again replaces what it wrote."""

    @property
    def folder(self) -> str:
        if self.path.split(":")[0] != "file":
            raise ValueError(f"pages are written to file: addresses only, not {self.path}")
        return "/" + self.path.split(":", 1)[1].lstrip("/")

    def put(self, name: str, body: bytes) -> None:
        os.makedirs(self.folder, exist_ok=True)
        private = f"{self.folder}/.{name}-{os.getpid()}-{id(body)}"
        with open(private, "wb") as out:
            out.write(body)
        os.replace(private, f"{self.folder}/{name}")

    def write(self, rows: Iterator) -> Written:
        last = -1
        for row in rows:
            if row["body"] is not None:  # a page without a body is one that failed
                self.put(f"page-{row['page']}.json", bytes(row["body"]))
            last = max(last, row["page"])
        return Written(last)

    def commit(self, messages: list) -> None:
        pages = max([page_count(self.path), *(m.last + 1 for m in messages if m)])
        self.put("index.json", json.dumps({"pages": pages}).encode())

    def abort(self, messages: list) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
