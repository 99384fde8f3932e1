"""Line dedup over the corpus: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of MIN_CHARS code points or more that
are found in `least` documents or more lose all their lines except in the smallest doc_id holding them. Each document gives
one row per distinct long key, 128 bits of hash and its id, written to the shared folder; counting keeps partial sums before
its shuffle, so a very common line costs one row a task. Only rows of repeated keys meet the documents again, and a text
moves once, to be put together from its kept lines in order.

Null or empty text: one empty line, kept. A null doc_id counts as one document that sorts after all others; rows that share
a doc_id are one document. Extra columns of documents pass through drop_lines() untouched.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import arrow_map, document_key, in_arrow, texts, unused, written

MIN_CHARS = 10
_ASCII_SPACE = b" \t\n\x0b\x0c\r"
_SIGN = 1 << 63


def line_key(line: bytes) -> bytes | None:
    """The key of a line in UTF-8, or None where it has fewer than MIN_CHARS code points. bytes.lower() maps A-Z alone."""
    key = line.strip(_ASCII_SPACE)
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key) - sum(0x80 <= b < 0xC0 for b in key) < MIN_CHARS:
        return None
    return key.lower()


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def own_part() -> F.Column:
    """Documents without an id are one document, but not one task's: each of their texts gets its drops by itself."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")


def line_keys(documents: DataFrame) -> DataFrame:
    """doc, part, h1, h2: a row for each document row and distinct long key in it."""

    def each(batch: pa.RecordBatch) -> dict:
        docs, parts, firsts, seconds = [], [], [], []
        for doc, part, text in zip(batch.column("doc").to_pylist(), batch.column("part").to_pylist(), texts(batch), strict=True):
            keys = {k for line in text.encode("utf-8", "surrogatepass").split(b"\n") if (k := line_key(line)) is not None}
            for k in keys:
                h = xxhash.xxh3_128_intdigest(k)
                docs.append(doc)
                parts.append(part)
                firsts.append((h >> 64) - _SIGN)
                seconds.append((h & 0xFFFFFFFFFFFFFFFF) - _SIGN)
        return {"doc": pa.array(docs, pa.int64()), "part": pa.array(parts, pa.int64()), "h1": pa.array(firsts, pa.int64()), "h2": pa.array(seconds, pa.int64())}

    return arrow_map(documents.select(document_key().alias("doc"), own_part().alias("part"), "text"), "doc long, part long, h1 long, h2 long", each)


def repeated_keys(keys: DataFrame, least: int = 2) -> DataFrame:
    """h1, h2, keeper of the keys in `least` documents or more. For two, the least and the greatest document tell it."""
    found = [F.min("doc").alias("keeper"), F.max("doc").alias("last")] + ([F.count_distinct("doc").alias("docs")] if least > 2 else [])
    counted = keys.groupBy("h1", "h2").agg(*found)
    return counted.where(F.col("docs") >= least if least > 2 else F.col("keeper") < F.col("last")).select("h1", "h2", "keeper")


def dropped_keys(documents: DataFrame, least: int = 2) -> DataFrame:
    """doc, part, drops: for each document the hashes of the keys whose lines it loses, 16 bytes each, end to end."""
    keys = written(line_keys(documents), "line-keys")
    # written as well, so that both sides of the join are dealt anew and a very common line's partition can be split
    lost = keys.join(written(repeated_keys(keys, least), "repeated-lines"), ["h1", "h2"]).where(F.col("doc") > F.col("keeper"))
    as_bytes = F.to_binary(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")), F.lit("hex"))
    return lost.select("doc", "part", as_bytes.alias("h")).groupBy("doc", "part").agg(F.collect_set("h").alias("drops"))


def _raw(h: bytes) -> bytes:
    """The stored form of a digest: both halves shifted into the signed range."""
    return bytes([h[0] ^ 0x80]) + h[1:8] + bytes([h[8] ^ 0x80]) + h[9:]


def kept_lines(text: str, drops: set[bytes]) -> tuple[list[bytes], int, int]:
    """The kept lines in order, the lines there were and the lines dropped."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    if not drops:
        return lines, len(lines), 0
    kept = [line for line in lines if (k := line_key(line)) is None or _raw(key_hash(k)) not in drops]
    return kept, len(lines), len(lines) - len(kept)


def _with_drops(documents: DataFrame, least: int) -> tuple[DataFrame, str]:
    """Document rows with what they lose, and the name of that column; the side with drops is the smaller one, so no text is sorted."""
    doc, part, name = unused(documents, "_doc"), unused(documents, "_part"), unused(documents, "_drops")
    drops = dropped_keys(documents, least).withColumnsRenamed({"doc": doc, "part": part, "drops": name})
    return documents.join(drops.hint("shuffle_hash"), (document_key() == F.col(doc)) & (own_part() == F.col(part)), "left").drop(doc, part), name


def line_dedup(documents: DataFrame, least: int = 2) -> DataFrame:
    """For each row of documents the counts of lines and the digest of what stays."""

    def each(batch: pa.RecordBatch) -> dict:
        lines, dropped, digests = [], [], []
        for text, drops in zip(texts(batch), batch.column("_drops").to_pylist(), strict=True):
            kept, n, lost = kept_lines(text, set(drops or ()))
            lines.append(n)
            dropped.append(lost)
            digests.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}

    joined, _ = _with_drops(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least)
    return arrow_map(joined.select("doc_id", "text", "_drops"), "doc_id long, n_lines long, n_dropped long, kept_sha256 string", each)


def drop_lines(documents: DataFrame, least: int = 2, length_column: str = "n_chars") -> DataFrame:
    """Documents with the kept lines as their text, all columns as before; the length column follows. Null texts stay null."""
    names = documents.columns
    joined, dropped = _with_drops(documents, least)

    def each(batches):
        for batch in batches:
            new = []
            for text, drops in zip(batch.column("text").to_pylist(), batch.column(dropped).to_pylist(), strict=True):
                new.append(text if text is None or not drops else b"\n".join(kept_lines(text, set(drops))[0]).decode("utf-8", "surrogatepass"))
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(new, pa.string())}
            if length_column in names:
                columns[length_column] = pa.array([old if x is None else len(x) for x, old in zip(new, batch.column(length_column).to_pylist(), strict=True)], pa.int64()).cast(batch.column(length_column).type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return in_arrow(joined, each, documents.schema)


#: The same in DuckDB's SQL.
ORACLE = r"""
with lines as (
  select doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents)
), repeated as (
  select key, min(doc_id) as keeper from lines where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), judged as (
  select l.doc_id, pos, line, r.key is not null and l.doc_id <> r.keeper as dropped from lines l left join repeated r on l.key = r.key
)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""
