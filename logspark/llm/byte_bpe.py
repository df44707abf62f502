"""Byte-level BPE encoding and decoding by a two-tier lookup.

Texts are split by the tokenizer's pattern. Pre-tokens that are whole vocabulary entries are
resolved, many at a time, through a minimal perfect hash over the vocabulary (one slot per
entry, each hit compared with its key). Misses are merged by rank: short ones over a list of
the ranks their pairs have, long ones with a heap of candidate pairs over linked bytes. Results
of both tiers are kept for the pre-tokens seen last, in a younger and an older half: when the
younger is full it becomes the older, so that frequent pre-tokens stay.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_TOKENS, MEMO_TOKENS = 1 << 16, 250_000
MEMO_BYTES, ENTRY_BYTES, OUT_BYTES = 24 << 20, 160, 4 << 20  # the memo's texts and ids, what an entry takes besides, a batch of ids
SHORT, NO_RANK = 64, 1 << 16  # bytes of a pre-token merged over a list, whose steps take time by its length; what a pair without a rank has


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f) if t}


class MinimalPerfectHash:
    """Hash and displace: n keys in n slots.

    Keys fall into buckets; from the largest bucket on, each gets the first displacement that
    sends its keys to free slots. A bucket of one key names its slot directly (negative).
    """

    PER_BUCKET, TRIED_AT_ONCE = 2, 256

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.buckets = max(1, n // self.PER_BUCKET)
        low, high, bucket = self._hash(keys)
        by_bucket = np.argsort(bucket, kind="stable")
        owners, first, counts = np.unique(bucket[by_bucket], return_index=True, return_counts=True)
        free, self.displace, self.key_at = np.ones(n, bool), np.zeros(self.buckets, np.int64), np.zeros(n, np.int64)
        for at in np.argsort(-counts, kind="stable").tolist():
            b, own = int(owners[at]), by_bucket[first[at]:first[at] + counts[at]]
            if len(own) == 1:
                break
            d, slots = self._place(low[own], high[own], free)
            free[slots], self.displace[b], self.key_at[slots] = False, d, own
        alone = counts == 1
        slots = np.flatnonzero(free)
        self.displace[owners[alone].astype(np.int64)], self.key_at[slots] = -slots - 1, by_bucket[first[alone]]
        self.keys = np.empty(n, object)
        self.keys[:] = [keys[i] for i in self.key_at]

    def _place(self, low: np.ndarray, high: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
        """The first displacement that puts these keys in different free slots, and the slots."""
        start = 0
        while True:
            d = np.arange(start, start + self.TRIED_AT_ONCE, dtype=np.uint64)
            slots = np.sort((low[:, None] + d * high[:, None]) % np.uint64(len(free)), axis=0)
            fits = free[slots].all(axis=0) & (slots[1:] != slots[:-1]).all(axis=0)
            if fits.any():
                d = start + int(fits.argmax())
                return d, ((low + np.uint64(d) * high) % np.uint64(len(free))).astype(np.int64)
            start += self.TRIED_AT_ONCE

    def _hash(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
        return h >> np.uint64(32), (mixed >> np.uint64(33)) | np.uint64(1), (h & np.uint64(0xFFFFFFFF)) % np.uint64(self.buckets)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Number of each key in the list the table was made of, -1 where it isn't there."""
        if not len(self.keys) or not keys:
            return np.full(len(keys), -1)
        low, high, bucket = self._hash(keys)
        d = self.displace[bucket.astype(np.int64)]
        moved = (low + np.maximum(d, 0).astype(np.uint64) * high) % np.uint64(len(self.keys))
        slots = np.where(d < 0, -d - 1, moved.astype(np.int64))
        asked = np.empty(len(keys), object)
        asked[:] = keys
        return np.where(self.keys[slots] == asked, self.key_at[slots], -1)


class ByteBpe:
    """Encoder and decoder of one vocabulary; ids are ranks, below 65,536."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: MinimalPerfectHash | None = None):
        self.pattern, self.vocabulary = regex.compile(pattern), {r: t for t, r in ranks.items()}
        self.table, self.ids = table or MinimalPerfectHash(list(ranks)), list(ranks.values())
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.joined = {left << 16 | right: r for t, r in ranks.items() for i in range(1, len(t))
                       if (left := ranks.get(t[:i])) is not None and (right := ranks.get(t[i:])) is not None}
        self.packed = [struct.pack("<I", r) for r in range(1 + max(ranks.values()))]
        self.first = {(t[0], t[1]): r for t, r in ranks.items() if len(t) == 2}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_bytes = 0

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: the pair of lowest rank, leftmost first, is joined next."""
        return self._merge_short(token) if len(token) <= SHORT else self._merge_long(token)

    def _merge_short(self, token: bytes) -> list[int]:
        """``due`` has the rank of each id and its next one. An id of -1 ends the list, on both sides: it has no rank with any."""
        joined, ids = self.joined.get, [self.single[b] for b in token]
        due = list(map(self.first.get, zip(token, token[1:]), repeat(NO_RANK)))
        ids.append(-1)
        due.append(NO_RANK)
        while (rank := min(due)) != NO_RANK:
            i = due.index(rank)
            ids[i] = rank
            del ids[i + 1], due[i]
            due[i] = joined(rank << 16 | ids[i + 1], NO_RANK)
            due[i - 1] = joined(ids[i - 1] << 16 | rank, NO_RANK)
        ids.pop()
        return ids

    def _merge_long(self, token: bytes) -> list[int]:
        """The heap holds rank and place of a pair in one number; ``due`` has the rank that the
        pair at a place has now, so that entries of pairs joined meanwhile are passed over."""
        joined, ids, n = self.joined.get, [self.single[b] for b in token], len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [joined(ids[i] << 16 | ids[i + 1], -1) for i in range(n - 1)]
        due.append(-1)
        heap = [r << 32 | i for i, r in enumerate(due) if r >= 0]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if due[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], due[j], due[i] = rank, -1, -1, -1
            if k < n:
                before[k] = i
                due[i] = r = joined(rank << 16 | ids[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                due[h] = r = joined(ids[h] << 16 | rank, -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _keep(self, token: str, ids: bytes) -> None:
        self.memo[token] = ids
        self.memo_bytes += 4 * len(token) + len(ids) + ENTRY_BYTES

    def _recall(self, tokens: set[str]) -> None:
        """Puts pre-tokens that the younger half lacks there, from the older half or resolved anew."""
        lacking = tokens.difference(self.older)
        for token in tokens - lacking:
            self._keep(token, self.older[token])
        new = list(lacking)
        data = [t.encode("utf-8", "surrogatepass") for t in new]
        for token, raw, at in zip(new, data, self.table.find(data).tolist()):
            self._keep(token, self.packed[self.ids[at]] if at >= 0 else b"".join(map(self.packed.__getitem__, self.merge(raw))))

    def blocks(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, in blocks of bounded length."""
        if len(text) <= BLOCK_TOKENS:
            parts = iter([self.pattern.findall(text)] if text else [])
        else:
            matches = map(regex.Match.group, self.pattern.finditer(text))
            parts = iter(lambda: list(islice(matches, BLOCK_TOKENS)), [])
        for block in parts:
            if 2 * len(self.memo) > MEMO_TOKENS or 2 * self.memo_bytes > MEMO_BYTES:
                self.older, self.memo, self.memo_bytes = self.memo, {}, 0
            if new := set(block).difference(self.memo):
                self._recall(new)
            yield b"".join(map(self.memo.__getitem__, block))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.blocks(text)), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


class Tokenizer:
    """A vocabulary file and pattern. The hash table is made once, on the driver, and broadcast with
    the ranks: their size is the vocabulary's, whatever the input."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        self.ranks, self.pattern = spark.sparkContext.broadcast((ranks, MinimalPerfectHash(list(ranks)), path)), pattern


_opened: dict[tuple, ByteBpe] = {}


def _codec(ranks, pattern: str) -> ByteBpe:
    """The worker's codec, kept from task to task for one vocabulary at a time."""
    if (ranks.value[2], pattern) not in _opened:
        _opened.clear()
        _opened[ranks.value[2], pattern] = ByteBpe(*ranks.value[:1], pattern, ranks.value[1])
    return _opened[ranks.value[2], pattern]


def encode_column(text: Column, tokenizer: Tokenizer) -> Column:
    """Ids of whole texts; null stays null."""
    ranks, pattern = tokenizer.ranks, tokenizer.pattern

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(ranks, pattern)
        return pa.array((None if t is None else codec.encode(t).view("<i4") for t in (x.as_py() for x in texts)), pa.list_(pa.int32()))

    return encode(text)


def decode_column(ids: Column, tokenizer: Tokenizer) -> Column:
    """The bytes that ids stand for; null stays null."""
    ranks, pattern = tokenizer.ranks, tokenizer.pattern

    @F.arrow_udf("binary")
    def decode(rows: pa.Array) -> pa.Array:
        codec = _codec(ranks, pattern)
        return pa.array((None if r is None else codec.decode(r) for r in (x.as_py() for x in rows)), pa.binary())

    return decode(ids)


def encoded(rows: DataFrame, tokenizer: Tokenizer, text_col: str = "text") -> DataFrame:
    """``rows`` with their text's ids instead of the text, checked: ids, n_tokens, decoded_sha256, round_trip.

    The ids are decoded block by block; round_trip says whether their bytes are the text's. A
    null text counts as empty; rows that repeat give equal rows; an empty table gives none.
    Ids leave in batches of bounded size, so a task holds those of a few texts, or of one very
    long one. The other columns may not have the new columns' names.
    """
    ranks, pattern = tokenizer.ranks, tokenizer.pattern
    kept = [c for c in rows.columns if c != text_col]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)

        def batch_of(batch: pa.RecordBatch, start: int, done: list[tuple]) -> pa.RecordBatch:
            own = batch.slice(start, len(done))
            ends = np.cumsum([0, *(d[1] for d in done)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(d[0] for d in done), "<i4")))
            columns = [own.column(c) for c in kept] + [ids, pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done]), pa.array([d[3] for d in done])]
            return pa.RecordBatch.from_arrays(columns, [*kept, "ids", "n_tokens", "decoded_sha256", "round_trip"])

        for batch in batches:
            start, done, room, texts = 0, [], OUT_BYTES, batch.column(text_col)
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                blocks, decoded = [], hashlib.sha256()
                for block in codec.blocks(text):
                    blocks.append(block)
                    decoded.update(codec.decode(np.frombuffer(block, "<u4").tolist()))
                ids = b"".join(blocks)
                same = decoded.digest() == hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                done.append((ids, len(ids) // 4, decoded.hexdigest(), same))
                room -= len(ids)
                if room < 0:
                    yield batch_of(batch, start, done)
                    start, done, room = i + 1, [], OUT_BYTES
            if done:
                yield batch_of(batch, start, done)

    return rows.mapInArrow(encode, schema)


def round_trip_column(text: Column, tokenizer: Tokenizer) -> Column:
    """Encode a text and decode its ids in one pass: n_tokens, ids_sha256, decoded_sha256.

    The text may not be null; rows that repeat give equal results, an empty table none.
    Digests are taken of the ids' little-endian bytes and of the decoded bytes, block by block.
    """
    ranks, pattern = tokenizer.ranks, tokenizer.pattern

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def round_trip(texts: pa.Array) -> pa.Array:
        codec, out = _codec(ranks, pattern), []
        for text in (t.as_py() for t in texts):
            count, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for block in codec.blocks(text):
                ids.update(block)
                numbers = np.frombuffer(block, "<u4").tolist()
                count += len(numbers)
                decoded.update(codec.decode(numbers))
            out.append({"n_tokens": count, "ids_sha256": ids.hexdigest(), "decoded_sha256": decoded.hexdigest()})
        return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return round_trip(text)
