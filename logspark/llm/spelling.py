"""Spelling variants: words one edit apart, and the frequent form of each rare one.

Two words are near when one code point is inserted, deleted or replaced: their common prefix
and common suffix then reach the longer length minus one. One of the two covers half of that,
so near words meet in the block of words that share a leading or a trailing half (of the longer
length). Blocks are dealt out in tiles, each pair of tiles by itself; a task packs small blocks
into one matrix of padded code points and compares all its rows at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed, text_of

MIN_LENGTH, MIN_COUNT, RATIO, DROP = 7, 2, 10, 31
TILE, CELLS = 1024, 1 << 18  # words a tile, code points a tile
_RUN = re.compile("[a-zÀ-ÿ]+")
_HELD = 200_000  # words that a task counts before it hands them on


def word_counts(text: str, row_id, drop: int = DROP) -> Counter:
    """Runs of letters, A-Z lowered, and how often each occurs; where ``drop`` divides the checksum of
    ``<id>:<run>``, the run loses the code point that the checksum names."""
    start, out = zlib.crc32(f"{'' if row_id is None else row_id}:".encode()), Counter()
    runs = _RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    for run, n in Counter(r for r in runs if len(r) >= MIN_LENGTH).items():
        h = zlib.crc32(run.encode(), start)
        if h % drop == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def _counted(drop: int, min_length: int):
    def flushed(counts: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if len(w) >= min_length]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for row_id, text in zip(batch.column("id"), batch.column("text")):
                counts.update(word_counts(text.as_py(), row_id.as_py(), drop))
                if len(counts) > _HELD:
                    yield flushed(counts)
                    counts = Counter()
        yield flushed(counts)

    return count


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, drop: int = DROP) -> DataFrame:
    """(word, n) of all words with enough code points and occurrences; a null text has none, a null id reads as empty."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    counts = rows.mapInArrow(_counted(drop, max(min_length, MIN_LENGTH)), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def single_edits(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, near): common prefix lengths, and which words are exactly one edit apart, all against all."""
    size = np.array([len(w) for w in words])
    width = int(size.max())
    points = np.zeros((len(words), width), np.uint32)
    flipped = np.zeros_like(points)
    for i, word in enumerate(words):
        row = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
        points[i, :len(row)], flipped[i, :len(row)] = row, row[::-1]

    def common(matrix: np.ndarray) -> np.ndarray:
        total, on = np.zeros((len(words),) * 2, np.int32), np.ones((len(words),) * 2, bool)
        for column in matrix.T:
            on &= (column[:, None] == column) & (column != 0)
            if not on.any():
                break
            total += on
        return total

    prefix, longer = common(points), np.maximum(size[:, None], size)
    near = (prefix + common(flipped) >= longer - 1) & (np.abs(size[:, None] - size) <= 1)
    np.fill_diagonal(near, False)  # the words differ from each other
    return prefix, near


_NEAR = "word string, n_near long, best_n long, best string"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and pair of tiles -> for each word the near words of its groups: how many, and the best."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("length", "back", "piece", "tiles", "side", "word", "n")))

    def groups():
        held = []
        for row in rows():
            if held and row[:4] != held[0][:4]:
                yield held
                held = []
            held.append(row)
        if held:
            yield held

    def compared(packed: list[list]) -> Iterator[tuple]:
        part = [r for g in packed for r in g]
        if not part:
            return
        words, counts = [r[5] for r in part], np.array([r[6] for r in part])
        length, back, side = (np.array([r[i] for r in part]) for i in (0, 1, 4))
        group = np.repeat(np.arange(len(packed)), [len(g) for g in packed])
        prefix, near = single_edits(words)
        size = np.array([len(w) for w in words])
        near &= (group[:, None] == group) & (np.maximum(size[:, None], size) == length)
        near &= ~back | (prefix < length // 2)  # those with the leading half in common meet there
        crossing = np.array([g[0][3] for g in packed])
        across = np.array([len(set(t.split("-"))) == 2 for t in crossing])[group]
        near &= ~across | (side[:, None] != side)
        for i in np.flatnonzero(near.any(axis=1)):
            others = np.flatnonzero(near[i])
            best = min(others, key=lambda j: (-counts[j], words[j]))
            yield words[i], len(others), int(counts[best]), words[best]

    def blocks():
        packed, cells, widest = [], 0, 0
        for group in groups():
            wide = max(widest, group[0][0])
            if packed and (cells + len(group) > TILE or (cells + len(group)) * wide > CELLS):
                yield packed
                packed, cells, wide = [], 0, group[0][0]
            packed, cells, widest = [*packed, group], cells + len(group), wide
        if packed:
            yield packed

    for packed in blocks():
        if found := list(compared(packed)):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], [x.split()[0] for x in _NEAR.split(", ")])


def _tile(length: Column, tile: int) -> Column:
    """Words a tile: fewer where they are very long."""
    return F.greatest(F.lit(2), F.least(F.lit(tile), F.floor(F.lit(CELLS) / length)))


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near word: their number, the largest count and its word.

    ``words`` holds each word once. Two near words meet in one block only, that of the longer
    length and the leading half if they share it, else the trailing half; there in one pair of tiles.
    """
    size = F.char_length("word")
    half = lambda length: F.floor(length / 2).cast("int")
    places = F.array(*(F.struct(length.alias("length"), F.lit(back).alias("back"), (F.right if back else F.left)(F.col("word"), half(length)).alias("piece"),
                                F.lit(longer).alias("longer")) for length, longer in ((size, True), (size + 1, False)) for back in (False, True)))
    placed = words.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.*")
    block = ["length", "back", "piece"]
    sizes = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("size"), F.max("longer").alias("any")).where("size > 1 and any")
    tiles = F.ceil(F.col("size") / _tile(F.col("length"), tile))
    dealt = placed.join(sizes, block).withColumn("of", tiles).withColumn("t", F.pmod(F.xxhash64("word"), "of"))
    dealt = dealt.select(*block, "word", "n", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("o"))
    pair = F.concat_ws("-", F.least("t", "o"), F.greatest("t", "o"))
    dealt = dealt.select(*block, pair.alias("tiles"), F.col("t").alias("side"), "word", "n")
    group = [*block, "tiles"]
    found = dealt.repartition(*group).sortWithinPartitions(*group, "word").mapInArrow(_compared, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last. Each round doubles the steps, and counts grow along a chain."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = checkpointed(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, tile: int = TILE, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    The form is the near word of largest n (ties: smallest by code point) if that is at least
    ``ratio`` times the word's own, else null; the root is the last of the forms, or the word.
    Rows that repeat count as often as they are there; an empty table has no words; other
    columns don't matter.
    """
    words = checkpointed(vocabulary(docs, id_col, text_col, **options))
    joined = words.join(near_words(words, tile), "word", "left")
    has = F.col("best_n") >= F.col("n") * ratio
    rows = checkpointed(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                      F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
