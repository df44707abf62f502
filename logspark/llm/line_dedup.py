"""Fuzzy line dedup: MinHash banding, exact Jaccard checks, one line kept per component.

Lines are compared without surrounding blanks, tabs and carriage returns; blank lines are
layout and always stay. Copies form one class by a 128-bit hash. Classes with a band key in
common meet in a bucket, where the exact Jaccard similarity of their character shingles
decides; the links' components are found by distributed star contractions and the first
line of each (smallest document id, then line) stays.

A pair that shares several buckets is compared in the first of them only, and a pair already
connected within its bucket not at all. Buckets are dealt out in tiles of ``TILE`` lines, each pair of tiles a
group of its own: no group grows with the data and no pair of tiles is left out. Buckets with
the same members are checked once. A text leaves its document only if its line shares a bucket,
a band key is dealt out only if a Bloom filter says that another line may have it too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import KeyFilter, packed, text_of
from logspark.llm.components import components
from logspark.session import stored

SHINGLE, BANDS, ROWS, SIMILARITY, TILE = 7, 10, 4, 0.8, 512  # a pair at 0.8 is found with probability 0.995
_BATCH_CHARS, _EDGES = 1 << 18, 1 << 12
_BLOCK_CHARS, _LINE_CHARS = 1 << 20, 64  # characters of lines handled at once, what a line counts besides
_FEW = 3  # lines of a group that are compared with each other most likely
_MIX = np.uint64(0x9E3779B97F4A7C15)  # golden ratio, the usual odd multiplier


_SLICES = [slice(i, i + SHINGLE) for i in range(4096)]


def shingles(line: str, width: int = SHINGLE) -> set[str]:
    """Character shingles; a shorter line is its own only shingle."""
    n = max(1, len(line) - width + 1)
    if width == SHINGLE and n <= len(_SLICES):
        return set(map(line.__getitem__, _SLICES[:n]))
    return {line[i:i + width] for i in range(n)}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _coefficients(n: int) -> np.ndarray:
    draw = np.random.default_rng(7).integers(0, 1 << 32, (2, n), dtype=np.uint64).astype(np.uint32)
    return np.stack([draw[0] | np.uint32(1), draw[1]])


def _minima(lines: list[str], width: int, n: int) -> np.ndarray:
    """MinHash values, one row of ``n`` for each line."""
    padded = [s if len(s) >= width else s + "\0" * (width - len(s)) for s in lines]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum([len(s) for s in padded])
    rolled = np.zeros(len(points) - width + 1, np.uint64)
    for j in range(width):
        rolled *= _MIX
        rolled += points[j:j + len(rolled)]
    inside = np.ones(len(rolled), bool)
    for back in range(1, width):  # shingles that would reach into the next line
        inside[ends[:-1] - back] = False
    rolled = rolled[inside] * _MIX
    rolled = ((rolled ^ (rolled >> np.uint64(29))) * _MIX >> np.uint64(32)).astype(np.uint32)
    counts = np.diff(ends, prepend=0) - width + 1
    starts = np.cumsum(counts) - counts
    a, b = _coefficients(n)
    return np.stack([np.minimum.reduceat(rolled * a[i] + b[i], starts) for i in range(n)], axis=1)


def minhash(lines: list[str], width: int = SHINGLE, n: int = BANDS * ROWS) -> np.ndarray:
    """MinHash of many lines in batches of bounded size; a very long line is read in overlapping pieces."""
    out, batch, room = [], [], _BATCH_CHARS
    for line in lines:
        if len(line) > _BATCH_CHARS:
            if batch:
                out.append(_minima(batch, width, n))
                batch, room = [], _BATCH_CHARS
            pieces = (line[i:i + _BATCH_CHARS + width - 1] for i in range(0, len(line) - width + 1, _BATCH_CHARS))
            out.append(np.minimum.reduce([_minima([p], width, n) for p in pieces]))
            continue
        batch.append(line)
        room -= len(line)
        if room < 0:
            out.append(_minima(batch, width, n))
            batch, room = [], _BATCH_CHARS
    if batch:
        out.append(_minima(batch, width, n))
    return np.concatenate(out) if out else np.zeros((0, n), np.uint32)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different bands never sharing a key but by chance."""
    cells = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cells.shape[:2]) * _MIX
    for j in range(rows):
        key = (key ^ cells[:, :, j]) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


_POS = pa.struct([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int32())])
_COLUMNS = {"pos": "struct<id:bigint,h:bigint,n:int>", "k1": "bigint", "k2": "bigint", "keys": "array<bigint>", "line": "string"}


def _numbered(text: str) -> Iterator[tuple[int, str]]:
    """The lines of a text that aren't blank, with their numbers."""
    n = start = 0
    while start <= len(text):
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        if line := text[start:end].strip(" \t\r"):
            yield n, line
        n, start = n + 1, end + 1


def _lines(docs: DataFrame, id_col: str, text_col: str, columns: tuple[str, ...], banding: tuple[int, int, int] | None = None,
           among: KeyFilter | None = None) -> DataFrame:
    """These columns of every line that isn't blank, or of those whose k1 the filter may hold: pos, which orders by
    document, then line; k1 and k2, the line's hash; line; keys, its band keys by ``banding`` (width, bands, rows)."""

    def block(found: list[tuple]) -> pa.RecordBatch:
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(f[3].encode("utf-8", "surrogatepass")) for f in found), "<i8").reshape(-1, 2)
        if among:
            at = np.flatnonzero(among.held(hashes[:, 0]))
            found, hashes = [found[i] for i in at], hashes[at]
        own = {"k1": pa.array(hashes[:, 0]), "k2": pa.array(hashes[:, 1])}
        ids, h, n, lines = zip(*found) if found else ((),) * 4
        own["pos"] = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(h, pa.int64()), pa.array(n, pa.int32())], fields=list(_POS))
        if "line" in columns:
            own["line"] = pa.array(lines, pa.string())
        if "keys" in columns:
            width, bands, rows = banding
            keys = band_keys(minhash(lines, width, bands * rows), bands, rows)
            own["keys"] = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays([own[c] for c in columns], list(columns))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, room = [], _BLOCK_CHARS
        for batch in batches:
            for i, h, text in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist(), batch.column("text")):
                for n, line in _numbered(text.as_py()):
                    found.append((i, h, n, line))
                    room -= len(line) + _LINE_CHARS
                    if room < 0:
                        yield block(found)
                        found, room = [], _BLOCK_CHARS
        if found:
            yield block(found)

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(blocks, ", ".join(f"{c} {_COLUMNS[c]}" for c in columns))


_EDGE = f"a {_COLUMNS['pos']}, b {_COLUMNS['pos']}"


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    first = np.empty(len(numbers), bool)
    first[:1] = True
    np.not_equal(numbers[1:], numbers[:-1], out=first[1:])
    return numbers[first]


class ShingleSets:
    """The shingle sets of a group's lines, each made when first asked for.

    A set is a sorted array of numbers that hold their shingle's characters side by side, numbered
    within the group; if the group has too many characters for 64 bits, it is a set of texts.
    """

    def __init__(self, lines: list[str], width: int):
        self.lines, self.width, self.sets = lines, width, [None] * len(lines)
        self.points = None if all(map(str.isascii, lines)) else np.array(sorted(map(ord, set().union(*lines))), np.uint32)
        self.bits = 8 if self.points is None else len(self.points).bit_length()
        self.packed = self.bits * width <= 64
        sizes = [len(s) for s in lines]
        if self.packed and len(lines) <= _FEW and sum(sizes) <= _BATCH_CHARS and min(sizes) >= width:  # few lines are made at once
            rolled, ends = self._rolled(self._codes("".join(lines))), np.cumsum(sizes).tolist()
            self.sets = [_distinct(rolled[e - n:e - width + 1]) for e, n in zip(ends, sizes)]

    def __getitem__(self, i: int):
        if self.sets[i] is None:
            self.sets[i] = self._numbers(self.lines[i]) if self.packed else shingles(self.lines[i], self.width)
        return self.sets[i]

    def _codes(self, text: str) -> np.ndarray:
        """Numbers of the characters from 1 on."""
        if self.points is None:
            codes = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
        else:
            codes = np.searchsorted(self.points, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")).astype(np.uint64)
        codes += np.uint64(1)
        return codes

    def _numbers(self, line: str) -> np.ndarray:
        codes = self._codes(line)
        if len(codes) < self.width:  # 0 fills up a line shorter than a shingle
            codes = np.pad(codes, (0, self.width - len(codes)))
        return _distinct(self._rolled(codes))

    def _rolled(self, codes: np.ndarray) -> np.ndarray:
        n, bits = len(codes) - self.width + 1, np.uint64(self.bits)
        out = codes[:n].copy()
        for j in range(1, self.width):
            out <<= bits
            out |= codes[j:j + n]
        return out

    def alike(self, i: int, j: int, similarity: float) -> bool:
        a, b = self[i], self[j]
        small, large = sorted((len(a), len(b)))
        if small < similarity * large:
            return False
        if isinstance(a, set):
            return jaccard(a, b) >= similarity
        merged = np.concatenate((a, b))
        merged.sort()
        both = int(np.count_nonzero(merged[1:] == merged[:-1]))
        return both / (len(a) + len(b) - both) >= similarity


def linked(members: list[tuple], similarity: float, width: int) -> Iterator[tuple]:
    """A spanning forest of the links among (side, pos, line, keys), for pairs that are to be compared here:
    the key of this bucket, the last field of each, is the first that both have; of one side only where all are equal."""
    cross = len({m[0] for m in members}) > 1
    sets, keys = ShingleSets([m[2] for m in members], width), [frozenset(m[3]) for m in members]
    root = list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, (side, pos, _, _, here) in enumerate(members):
        for j in range(i):
            if (cross and members[j][0] == side) or find(i) == find(j) or min(keys[i] & keys[j]) != here:
                continue
            if sets.alike(i, j, similarity):
                root[find(i)] = find(j)
                yield members[j][1], pos


def _verified(similarity: float, width: int):
    """Arrow function over rows sorted by bucket and tiles, which holds one group at a time."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pos = zip(*(f.to_pylist() for f in batch.column("pos").flatten()))
            key, tiles, side, line, keys = (batch.column(c).to_pylist() for c in ("key", "tiles", "side", "line", "keys"))
            yield from zip(key, tiles, side, pos, line, keys)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, group in groupby(rows(batches), lambda r: r[:2]):
            yield from linked([(*r[2:], r[0]) for r in group], similarity, width)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = edges(batches)
        while block := list(islice(found, _EDGES)):
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in block], _POS) for i in (0, 1)], ["a", "b"])

    return verify


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """(id, h, n, kept_id): line n (from 0) of the document is a copy of a line kept in kept_id.

    A document is a row's id and text (h is the text's hash): rows that repeat both share
    their lines and lose the same ones. A null id counts as the smallest, a null text as empty.
    """
    return _dropped(docs, id_col, text_col, similarity, width, bands, rows, tile).distinct()


def _dropped(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, width: int = SHINGLE, bands: int = BANDS,
             rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """``duplicate_lines``, those of a row that repeats as often as the row."""
    classes = stored(
        _lines(docs, id_col, text_col, ("pos", "k1", "k2", "keys"), (width, bands, rows))
        .groupBy("k1", "k2").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")), "line-classes")
    buckets = stored(classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "line-keys")
    keyed = classes.select(F.explode(KeyFilter(buckets, "key").only_held(F.col("keys"))).alias("key"), "k1")
    members = stored(keyed.join(buckets, "key"), "line-buckets")
    # buckets with the same members: those of a size and of the same sums of their members' hashes
    alike = members.groupBy("key", "size").agg(F.bit_xor("k1").alias("x"), F.min("k1").alias("m"))
    once = alike.groupBy("size", "x", "m").agg(F.min("key").alias("key")).select("key")
    members = stored(members.join(once, "key"), "line-members")
    # two classes may meet in several buckets; the first that both are in compares them
    wanted = members.groupBy("k1").agg(F.collect_list("key").alias("keys")).join(classes.select("k1", "pos"), "k1")
    texts = _lines(docs, id_col, text_col, ("pos", "line"), among=KeyFilter(members, "k1")).join(wanted, "pos")
    tiles = F.ceil(F.col("size") / tile)
    dealt = (members.join(texts, "k1").withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("pos"), "tiles"))
             .select("key", "pos", "line", "keys", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("o"))
             .select("key", F.concat_ws("-", F.least("t", "o"), F.greatest("t", "o")).alias("tiles"), F.col("t").alias("side"), "pos", "line", "keys"))
    edges = (dealt.repartition("key", "tiles").sortWithinPartitions("key", "tiles", "pos")
             .mapInArrow(_verified(similarity, width), _EDGE))
    kept = components(edges).withColumnsRenamed({"node": "pos", "component": "keep"})
    repeated = stored(classes.select("k1", "k2", "pos", "n").join(kept, "pos", "left")
                      .withColumn("keep", F.coalesce("keep", "pos")).where("n > 1 or pos <> keep").select("k1", "k2", "keep"), "line-copies")
    # without the class keys the rows are dealt anew, so that a join skewed by a common line may be split
    copies = _lines(docs, id_col, text_col, ("pos", "k1", "k2"), among=KeyFilter(repeated, "k1"))
    return (copies.join(repeated, ["k1", "k2"]).where("pos <> keep")
            .select("pos.id", "pos.h", "pos.n", F.col("keep.id").alias("kept_id")))


def _by_document(dropped: DataFrame) -> DataFrame:
    return dropped.groupBy("id", "h").agg(F.sort_array(F.collect_set("n")).alias("dropped"),
                                          F.array_sort(F.collect_set("kept_id")).alias("kept_ids"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, n_lines, dropped (line numbers from 0) and kept_ids (documents that keep those lines)."""
    found = _by_document(_dropped(docs, id_col, text_col, **options))
    text = text_of(text_col)
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), (breaks + 1).alias("n_lines")).alias("d")
    f = found.alias("f")
    return base.join(f, F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.h") == F.col("f.h")), "left").select(
        "d.id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        F.coalesce("kept_ids", F.array().cast("array<bigint>")).alias("kept_ids"))


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines of these numbers."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for body, gone in zip(texts.to_pylist(), map(set, numbers.to_pylist())):
            out.append("\n".join(s for i, s in enumerate(body.split("\n")) if i not in gone))
        return pa.array(out, pa.string())

    return cut(text, dropped)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the duplicate lines; a document of which no line but blank ones is left goes.

    All columns and untouched texts stay as they are (a null text stays null).
    """
    found = _by_document(_dropped(docs, id_col, text_col, **options)).select("id", "h", "dropped").alias("f")
    rows = packed(docs, id=F.col(id_col), h=F.xxhash64(text_of(text_col))).alias("d")
    joined = rows.join(found, F.col("d.id").eqNullSafe(F.col("f.id")) & (F.col("d.h") == F.col("f.h")), "left").select("row", "dropped")
    hit, own = F.col("dropped").isNotNull(), [F.col("row")[c].alias(c) for c in docs.columns]
    left = without_lines(F.col("row")[text_col], F.col("dropped"))
    cleaned = joined.where(hit).withColumn("left", left).where(F.col("left").rlike(r"[^ \t\r\n]"))
    return joined.where(~hit).select(*own).unionByName(cleaned.select(*(F.col("left").alias(c) if c == text_col else x for c, x in zip(docs.columns, own))))
