"""Document fingerprints: weighted SimHash of 128 bits, searched through permuted block tables.

Terms are words (A-Z lowered, weight by length up to ten bytes) and pairs of neighbouring words
(weight one), repeats included. A bit is set where the terms that have it weigh over half.

For the search a fingerprint is cut into eight blocks. Two fingerprints at most six bits apart
agree in at least two blocks, so tables keyed by every two blocks find all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import KeyFilter, checkpointed, text_of, word_blocks

BITS, RADIUS, BLOCKS = 128, 6, 8
#: Blocks of neighbouring ids: about this many rows each, never more than MAX_RANGES of them.
ROWS_PER_RANGE, MAX_RANGES = 1024, 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # usual odd multipliers
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
_PLANE = np.arange(BITS // 8, dtype=np.int64) * 256


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def fingerprint(text: str) -> np.ndarray:
    """The 128 bits as two 64-bit numbers; a text without words gives zero."""
    votes, whole, last = np.zeros(BITS), 0.0, None
    for words in word_blocks(text.encode("utf-8", "surrogatepass").lower()):
        if not words:
            continue
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        weight = np.minimum(np.fromiter(map(len, words), float, len(words)), 10) / 10
        chain = h if last is None else np.r_[last, h]
        pairs = _mixed(chain[:-1] * _A + chain[1:])
        terms, weight, last = np.r_[h, pairs], np.r_[weight, np.ones(len(pairs))], h[-1:]
        cells = np.stack([terms, _mixed(terms * _A)], axis=1).view(np.uint8) + _PLANE
        votes += (np.bincount(cells.ravel(), np.repeat(weight, BITS // 8), 32 * BITS).reshape(-1, 256) @ _BYTE_BITS).ravel()
        whole += weight.sum()
    return np.packbits(votes * 2 > whole * (1 + 1e-12), bitorder="little").view("<u8")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine that the share of differing bits stands for, 0 at right angles or beyond."""
    apart = int(np.bitwise_count(a ^ b).sum())
    return max(0.0, math.cos(math.pi * apart / BITS)) if apart else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many leading characters of the next text."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (range, ghost, key, id, text) dealt by range of ids and sorted in it.

    Each range ends with a ghost: the first row of the next range (of the first, after the
    last), so that every row's successor is the row behind it. The table of first rows is
    broadcast; it has a row a range, MAX_RANGES at most.
    """
    low, high, count = docs.agg(F.min(id_col), F.max(id_col), F.count(F.lit(1))).first()
    low, high = low or 0, high or 0
    ranges = min(max(1, count // ROWS_PER_RANGE), MAX_RANGES)
    width = float((high - low) // ranges + 1)
    key = F.coalesce(F.col(id_col), F.lit(low))
    offset = key.cast("double") - F.lit(float(low))  # rounding keeps the order, which is all that ranges need
    rows = docs.select(F.floor(offset / F.lit(width)).cast("long").alias("range"), key.alias("key"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    order = Window.orderBy("range")
    heads = (rows.groupBy("range").agg(F.min("key").alias("head"))
             .withColumn("to", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())))
             .select("head", "to"))
    joined = rows.join(F.broadcast(heads), rows["key"] == heads["head"], "left")
    places = F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("ghost")),
                                     F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("range"), F.lit(True).alias("ghost")))))
    dealt = joined.select(F.explode(places).alias("p"), "key", "id", "text").select("p.range", "p.ghost", "key", "id", "text")
    return dealt.repartition("range").sortWithinPartitions("range", "ghost", "key", F.col("id").asc_nulls_first(), "text")


_COLUMNS = "id long, n_chars long, edited_sha256 string, hi long, lo long, edited_hi long, edited_lo long, near_edited double, near_next double"


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None  # the row that waits for its successor
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            span, ghost, at, text = (batch.column(c)[i].as_py() for c in ("range", "ghost", "id", "text"))
            now = fingerprint(text)
            if before and before[0] == span and not before[1]:
                _, _, own, body, bits = before
                changed = edited(body, text)
                other = fingerprint(changed)
                out.append((own, len(body), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            *(int(x) for x in np.r_[bits, other].view(np.int64)), likeness(bits, other), likeness(bits, now)))
            before = span, ghost, at, text, now
        if out:
            names = [c.split()[0] for c in _COLUMNS.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
            types = [kinds[c.split()[1]] for c in _COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, a row for each row of ``docs``.

    The next document is that with the next larger id; repeated ids follow each other by text,
    null ids come first, and after the last row comes the first. A null text counts as empty.
    """
    return _neighbours(docs, id_col, text_col).mapInArrow(_fingerprinted, _COLUMNS)


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (q_hi, q_lo, hi, lo) at most ``radius`` bits apart, equal ones included, each pair once.

    Both inputs hold (hi, lo), each fingerprint once. A pair is reported by the first table
    in which it meets, so no repeats need to be removed afterwards.

    Rows are sized before they are multiplied by the tables, so neither side may be broadcast;
    a filter of fixed size keeps keys that nobody asks for out of the shuffle.
    """
    agreeing = BLOCKS - radius
    if agreeing < 1:
        raise ValueError(f"the radius must be below {BLOCKS}")
    span = BITS // BLOCKS

    def block(hi, lo, i):
        word, shift = (hi, i * span) if i * span < 64 else (lo, i * span - 64)
        return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << span) - 1))

    tables = list(combinations(range(BLOCKS), agreeing))
    masks = [sum(1 << i for i in t) for t in tables]
    hi, lo = F.col("hi"), F.col("lo")
    keys = [F.xxhash64(F.lit(m), *(block(hi, lo, i) for i in t)) for m, t in zip(masks, tables)]  # a key names its table, too

    rows = [F.struct(F.lit(m).alias("mask"), F.lit((2 << t[-1]) - 1).alias("upto"), k.alias("key")) for m, t, k in zip(masks, tables, keys)]
    asked = queries.select(hi.alias("q_hi"), lo.alias("q_lo"), F.explode(F.array(*rows)).alias("t")).select("q_hi", "q_lo", "t.*")
    held = F.array_distinct(KeyFilter(asked, "key").only_held(F.array(*keys)))
    keyed = prints.select("hi", "lo", F.explode(held).alias("key"))
    x_hi, x_lo = F.col("hi").bitwiseXOR(F.col("q_hi")), F.col("lo").bitwiseXOR(F.col("q_lo"))
    agree = sum(F.when(block(x_hi, x_lo, i) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(BLOCKS))
    near = (F.bit_count(x_hi) + F.bit_count(x_lo) <= radius) & (agree.bitwiseAND(F.col("upto")) == F.col("mask"))
    return keyed.hint("merge").join(asked.hint("merge"), "key").where(near).select("q_hi", "q_lo", "hi", "lo")


def count_near(found: DataFrame, every: int = 50, radius: int = RADIUS) -> DataFrame:
    """Adds n_near to rows whose id is divisible by ``every``: other rows within the radius (else null)."""
    sizes = found.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("rows"))
    asked = found.where(F.col("id") % every == 0).select("hi", "lo").distinct()
    pairs = within_radius(asked, sizes.select("hi", "lo"), radius)
    near = pairs.join(sizes, ["hi", "lo"]).groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg((F.sum("rows") - 1).alias("near"))
    rows = found.join(near, ["hi", "lo"], "left")
    return rows.withColumn("n_near", F.when(F.col("id") % every == 0, F.col("near"))).drop("near")


def searched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return count_near(checkpointed(fingerprints(docs, id_col, text_col)))
