"""SimHash near-dedup: 64-bit fingerprints linked at a small Hamming distance.

A fingerprint is cut into fewer segments than the distance would need for an exact match, so
that in any pair to be found one segment differs by at most one bit. Every segment is indexed
under its one-wildcard variants (one bit masked out) and once as it is; an equality join on
the variants finds the pairs and the whole distance verifies them. Only fingerprints that
differ take part: copies share a class, so a group of copies of any size adds one row.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed, packed, text_of, word_blocks
from logspark.llm.components import components

WIDTH, SEED, MAX_BITS = 3, 42, 2
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_PLANE = np.arange(8, dtype=np.int64) * 256


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    cells = hashes.view(np.uint8).reshape(-1, 8) + _PLANE
    return (np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def simhash(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text: a bit is 1 if set in over half the shingles' XXH64."""
    votes, total, tail = np.zeros(64), 0, []
    for words in word_blocks(text.lower()):  # bytes.lower touches A-Z only
        words = tail + words
        if len(words) < width:
            tail = words
            continue
        count = len(words) - width + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        votes += _votes(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, count))
        total, tail = total + count, words[count:]
    if not total and tail:
        votes, total = _votes(np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)), 1
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, width: int = WIDTH, seed: int = SEED) -> Column:
    """SimHash of a text column as a signed 64-bit number."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array((simhash(t.as_buffer().to_pybytes(), width, seed) for t in texts.cast(pa.binary())), pa.int64())

    return fingerprint(text)


def close_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, fp: str = "fp") -> DataFrame:
    """Pairs (a, b) of different fingerprints at most ``max_bits`` bits apart, each pair at least once.

    ``prints`` holds each fingerprint once. With s segments some segment of a pair differs by
    at most one bit when max_bits < 2 s; the two sides of a wildcard join differ in just the
    masked bit, and segments that are equal meet in the exact variant.
    """
    segments = next(s for s in (1, 2, 4, 8, 16, 32) if max_bits < 2 * s)
    span = 64 // segments
    mask = (1 << span) - 1 if span < 64 else -1
    segment = F.shiftrightunsigned(F.col(fp), 0) if span == 64 else None
    variants = []
    for s in range(segments):
        value = segment if segment is not None else F.shiftrightunsigned(F.col(fp), s * span).bitwiseAND(F.lit(mask))
        for i in range(span):
            bit = F.shiftrightunsigned(value, i).bitwiseAND(F.lit(1)).cast("byte")
            signed = (1 << i) - (1 << 64) * (i == 63)
            variants.append(F.struct(F.lit(s * span + i).cast("short").alias("spot"),
                                     value.bitwiseAND(F.lit(~signed)).alias("key"), bit.alias("side")))
        variants.append(F.struct(F.lit(64 + s).cast("short").alias("spot"), value.alias("key"), F.lit(2).cast("byte").alias("side")))
    rows = prints.select(F.col(fp).alias("fp"), F.explode(F.array(*variants)).alias("v")).select("fp", "v.*")
    low = rows.where("side <> 1").select(F.col("fp").alias("a"), "spot", "key")
    high = rows.where("side <> 0").select(F.col("fp").alias("b"), "spot", "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return low.join(high, ["spot", "key"]).where(near & (F.col("a") != F.col("b"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component): the component is the smallest id reachable over links.

    One row per row of ``docs``. A null text counts as empty; texts without words have
    fingerprint zero and link like any other. Rows with a null id get a fingerprint and the
    component of their fingerprint, which is null where no row of the component has an id.
    """
    rows = docs.select(F.col(id_col).alias("id"), fingerprint_column(text_of(text_col), width, seed).alias("fp"))
    return _grouped(checkpointed(rows), max_bits).select("id", "fp", "component")


def _grouped(base: DataFrame, max_bits: int) -> DataFrame:
    """``base`` (id, fp, ...) with label (a fingerprint of the group, one for each) and component."""
    classes = checkpointed(base.groupBy("fp").agg(F.min("id").alias("first")))
    linked = components(close_fingerprints(classes, max_bits)).withColumnsRenamed({"node": "fp"})
    named = classes.join(linked, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component"))
    return base.join(named.join(smallest, "label").select("fp", "label", "component"), "fp")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
               seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each group of linked fingerprints, that with its smallest id; all columns stay.

    Rows are told apart by id, text and their other columns: where several of a group share the
    smallest id, that of the smallest text hash, then the smallest hash of the other columns,
    stays, whatever their order; rows of one id in different groups stand for their own
    groups. A row without an id stays, as it can't be named.
    """
    others = [docs[f"`{c}`"] for c in docs.columns if c not in (id_col, text_col)]
    own = {"id": F.col(id_col), "h": F.xxhash64(text_of(text_col)), "r": F.xxhash64(F.to_json(F.struct(F.lit(1).alias("one"), *others)))}
    base = checkpointed(docs.select(*(c.alias(n) for n, c in own.items()), fingerprint_column(text_of(text_col), width, seed).alias("fp")))
    firsts = _grouped(base, max_bits).where("id is not null").groupBy("label").agg(F.min(F.struct("id", "h", "r")).alias("first")).select("first.*")
    named = packed(docs, **own).join(firsts, ["id", "h", "r"], "left_semi").dropDuplicates(["id", "h", "r"]).select("row.*")
    return named.unionByName(docs.where(F.col(id_col).isNull()))
