"""Quality rules with compression bands: repetitive or incompressible text goes.

A text's zstandard ratio (compressed bytes over bytes) depends on its length, so the limits do
too: ``LIMITS`` gives the lowest and highest ratio at a few lengths, and between them limits run
straight over the logarithm of the length. The whole text is judged, and each fixed chunk of it
by itself; a text goes when its whole ratio is out of its band, or when chunks out of theirs
hold more than ``BAD_SHARE`` of its bytes. Base rules on words come first.

The limits are parameters, set for prose of alphabets and scripts alike (about 0.65 at 256
bytes, 0.42 at 16 KiB): the lower ones lie a third or more below, the upper ones under what
random letters and digits reach. They aren't learnt from the input.
"""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import text_of

LEVEL, CHUNK, BAD_SHARE = 3, 4096, 0.3
#: Bytes, lowest ratio, highest ratio.
LIMITS = ((64, 0.45, 1.10), (256, 0.40, 0.85), (1024, 0.36, 0.70), (4096, 0.33, 0.62), (16384, 0.29, 0.58), (65536, 0.27, 0.56))
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS, SPACES = b"#*$%&|<>", bytes(range(9, 14)) + b" "
_CONTINUATION = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_PIECE = 1 << 20


def limits_at(size: int, limits=LIMITS) -> tuple[float, float]:
    """Lowest and highest ratio of a text of ``size`` bytes; beyond the table's ends its first or last row holds."""
    at = [math.log(x[0]) for x in limits]
    return tuple(float(np.interp(math.log(max(size, 1)), at, [x[i] for x in limits])) for i in (1, 2))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more, first ones included.

    Windows are compared exactly: equal windows of a length get one number, from which those of
    the next length are made, so neither windows nor hashes of them are kept.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    number = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        number = np.unique(number[:-step] * (number.max() + 1) + number[step:], return_inverse=True)[1]
        width += step
    found = (np.bincount(number)[number] > 1).astype(np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += found
    edges[window:] -= found
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, count = set(), 0
    for line in data.split(b"\n"):
        if line.strip(SPACES):
            count += line in seen
            seen.add(line)
    return count


def _ratio(data: memoryview) -> float:
    compressor = zstandard.ZstdCompressor(level=LEVEL).compressobj(size=len(data))
    size = sum(len(compressor.compress(data[i:i + _PIECE])) for i in range(0, len(data), _PIECE))
    return (size + len(compressor.flush())) / len(data)


def _outside(size: int, ratio: float, limits) -> int:
    low, high = limits_at(size, limits)
    return -1 if ratio < low else int(ratio > high)


@dataclass(frozen=True)
class Measured:
    """What is measured of a text; the fields are the columns of ``measures_column``."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    ratio: float | None
    repetitive_share: float
    incompressible_share: float
    base_failed: bool
    verdict: str


def measure(data: bytes, limits=LIMITS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> Measured:
    """All measures of one UTF-8 text. Texts and last chunks shorter than the first limit aren't judged by ratio."""
    words, view = data.split(), memoryview(data)
    dense = data.translate(None, SPACES)
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    least, ratio, whole, shares = limits[0][0], None, 0, {-1: 0, 0: 0, 1: 0}
    if len(data) >= least:
        ratio = _ratio(view)
        whole = _outside(len(data), ratio, limits)
        for at in range(0, len(data), chunk):
            part = view[at:at + chunk]
            if len(part) >= least:
                shares[_outside(len(part), _ratio(part), limits)] += len(part)
    low, high = (shares[k] / max(len(data), 1) for k in (-1, 1))
    verdict = "base" if failed else "repetitive" if whole < 0 or low > bad_share else "incompressible" if whole > 0 or high > bad_share else "kept"
    return Measured(len(words), len(dense.translate(None, _CONTINUATION)), len(data) - len(data.translate(None, SYMBOLS)), repeated_lines(data), repeats,
                    ratio, low, high, failed, verdict)


_TYPE = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, "
         "repetitive_share double, incompressible_share double, base_failed boolean, verdict string")
_KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def measures_column(text: Column, limits=LIMITS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> Column:
    """Struct of ``Measured`` for whole texts; the text may not be null."""
    names, kinds = zip(*(x.split() for x in _TYPE.split(", ")))

    @F.arrow_udf(_TYPE)
    def measures(texts: pa.Array) -> pa.Array:
        rows = [astuple(measure(t.as_py(), limits, chunk, bad_share)) for t in texts]
        columns = zip(*rows) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], names=list(names))

    return measures(text.cast("binary"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, measures, kept) for every row.

    A null text counts as empty (no words, so the base rules fail it); a null id stays null;
    rows that repeat are judged alike; an empty table gives no rows; other columns don't matter.
    """
    rows = docs.select(F.col(id_col).alias("id"), measures_column(text_of(text_col), **options).alias("m"))
    return rows.select("id", "m.*", (F.col("m.verdict") == "kept").alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows that all rules keep, with their columns."""
    return docs.where(measures_column(text_of(text_col), **options)["verdict"] == "kept")
