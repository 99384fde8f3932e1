"""Byte-level BPE by two tiers.

Tier 1: a minimal perfect hash (hash, displace and compress) over the vocabulary resolves a pre-token that is itself an
entry: one displacement, one slot, one comparison of bytes. Tier 2, for the rest: the bytes form a doubly linked list, a
heap holds the ranked neighbouring pairs, and the lowest rank (leftmost on ties) is merged until none is left.

Pre-tokens repeat, so each task remembers the packed ids of those it has met, up to MEMO_BYTES and those of one text, and
starts anew beyond that; the memory is bounded and no text is cut. Ids are packed as little-endian unsigned 32-bit integers.

Null text reads as empty: no ids, digests of nothing. Repeated rows and ties give the same result row by row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from leafmill.llm.common import WordMemory, arrow_map, texts

#: bytes of pre-tokens, with their ids, that a task remembers before it starts anew
MEMO_BYTES = 120_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings to their ids: hash, displace. No slot is empty; a lookup compares the key once."""

    def __init__(self, ids: dict[bytes, int]):
        self.n = n = len(ids)
        self.buckets = max(1, n // 2)
        self.shift = array("l", [0]) * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = array("l", [-1]) * n
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in ids:
            h = xxhash.xxh3_64_intdigest(key)
            groups[h % self.buckets].append((h >> 20, key))
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if not group:
                break
            if len(group) == 1:  # one key goes to any free slot, told directly
                free = iter([i for i, k in enumerate(self.keys) if k is None]) if free is None else free
                slots, self.shift[b] = [next(free)], 0
                self.shift[b] = -1 - slots[0]
            else:
                d = 0
                while True:
                    slots = [self._slot(h, d) for h, _ in group]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for s, (_, key) in zip(slots, group, strict=True):
                self.keys[s], self.values[s] = key, ids[key]

    def _slot(self, h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 >> 13 & 0xFFFFFFFFFFFF) % self.n

    def get(self, key: bytes) -> int:
        """The id, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets] if self.n else 0
        if not self.n:
            return -1
        s = -1 - d if d < 0 else self._slot(h >> 20, d)
        return self.values[s] if self.keys[s] == key else -1


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.words = PerfectHash(self.ranks)
        self.pieces = regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.memo = WordMemory(MEMO_BYTES, self.piece_ids)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: a heap of ranked pairs over linked bytes."""
        rank, n = self.ranks.get, len(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank << 32 | position: the lowest rank, and of equals the leftmost, comes first
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            left = parts[i]
            j = after[i]
            if left is None or j >= n or rank(left + parts[j]) != r:
                continue  # one side has been merged meanwhile
            parts[i], parts[j] = left + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return [self.ranks[x] for x in parts if x is not None]

    def piece_ids(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.words.get(raw)
        return array("I", [whole] if whole >= 0 else self.merge(raw)).tobytes()

    def encode_packed(self, text: str) -> bytes:
        pieces = self.pieces(text)
        memo = self.memo.learn(set(pieces))
        return b"".join([memo[p] for p in pieces])

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker, whichever tasks it runs."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def round_trip(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes every whole text and decodes its ids: counts and digests of both."""

    def each(batch: pa.RecordBatch, bpe: ByteBpe) -> dict:
        counts, encoded, decoded = [], [], []
        for text in texts(batch):
            packed = bpe.encode_packed(text)
            counts.append(len(packed) // 4)
            encoded.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(memoryview(packed).cast("I").tolist())).hexdigest())
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(encoded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    return arrow_map(documents.selectExpr(f"`{id_column}` as doc_id", f"`{text_column}` as text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", each, lambda: loaded(path, pattern))


def encode(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the ids themselves."""

    def each(batch: pa.RecordBatch, bpe: ByteBpe) -> dict:
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "ids": pa.array([bpe.encode(t) for t in texts(batch)], pa.list_(pa.int64()))}

    return arrow_map(documents.selectExpr(f"`{id_column}` as doc_id", f"`{text_column}` as text"), "doc_id long, ids array<long>", each, lambda: loaded(path, pattern))
