"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.session import shared_dir

#: ASCII white space, the word separators of the contracts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The column's text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, counted on the JVM without Python."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def word_blocks(data: bytes, size: int = BLOCK_BYTES):
    """The words of a text in blocks of about ``size`` bytes, so that very long texts stay bounded."""
    start = 0
    while start < len(data):
        cut = _SPACE.search(data, start + size)
        end = cut.end() if cut else len(data)
        yield data[start:end].split()
        start = end


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """``df``'s rows as one struct column, ``row``, beside columns of an operator's own, so that no names clash."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"), *(c.alias(n) for n, c in own.items()))


#: Bits of a ``KeyFilter``: its size is the same whatever it is made of (16 MiB at 64-bit words).
FILTER_BITS, FILTER_HASHES = 1 << 27, 4
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)  # usual odd multipliers


def _bits(keys: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Places of each key's bits, by one multiplier or several."""
    mixed = keys.view(np.uint64) * spread
    return (mixed ^ (mixed >> np.uint64(32))) % np.uint64(FILTER_BITS)


class KeyFilter:
    """Bloom filter of 64-bit keys, of a fixed size, broadcast to let rows that can't join stay where they are.

    It only saves shuffling: an exact join follows. Made of more keys than about a tenth of its bits it
    lets more rows through, up to all of them. Its words are put together in tasks.
    """

    def __init__(self, keys: DataFrame, column: str):
        def words(batches):
            for batch in batches:
                at = _bits(np.asarray(batch.column(0)).astype(np.int64)[:, None], _SPREAD).ravel()
                word, mask = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                order = np.argsort(word, kind="stable")
                first = np.flatnonzero(np.diff(word[order], prepend=-1))
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(word[order][first]), pa.array(np.bitwise_or.reduceat(mask[order], first).view(np.int64))], ["word", "mask"])

        found = keys.select(column).where(F.col(column).isNotNull()).mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        table = np.zeros(FILTER_BITS // 64, np.int64)
        table[found["word"].to_numpy()] = found["mask"].to_numpy()
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def held(self, keys: np.ndarray) -> np.ndarray:
        """False for keys that the filter wasn't made of, but for few; true for all that it was made of."""
        keys, words = np.asarray(keys).astype(np.int64), self.table.value.view(np.uint64)
        left = np.arange(len(keys))
        for spread in _SPREAD:  # most keys go at the first bit
            at = _bits(keys[left], spread)
            left = left[(words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        hit = np.zeros(len(keys), bool)
        hit[left] = True
        return hit

    def only_held(self, keys: Column) -> Column:
        """The keys of an array that may be held; none of a null array. Keys come as arrays so that the
        rows that wait for Python are few."""

        @F.arrow_udf("array<long>")
        def pick(rows: pa.Array) -> pa.Array:
            hit, ends = self.held(rows.flatten()), np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(rows), 0)))]
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(hit)][ends].astype(np.int32)), rows.flatten().filter(pa.array(hit)))

        return pick(keys)
