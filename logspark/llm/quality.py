"""Quality classifier by compression: dictionaries of good and of bad text, size difference as score.

Two zstandard dictionaries are built from labelled text. A text that is like the good examples
compresses better with the first, one like the bad examples with the second; the normalised
difference of the two sizes, its signed square, both compressed/length ratios and the bounded
log length are calibrated to a probability by a logistic regression over labelled texts that
built no dictionary (README has the figures with and without the difference). Texts are used whole, in training as in scoring, and
compressed in blocks, so that a long one is measured by the dictionaries throughout and not by
its own earlier lines.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed, text_of

#: Training bound: labelled documents a class, each taken whole.
PER_CLASS, DICT_BYTES, LEVEL, THRESHOLD = 2000, 112_640, 3, 0.3
#: Every block of a text is compressed by itself; the sizes add up over the whole text.
BLOCK = 4096
DICT_SHARE = 0.6  # of the examples build dictionaries, the others calibrate


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, max(len(text), 1), BLOCK)]


def _dictionary(texts: Iterable[bytes]) -> tuple[bytes, int]:
    """A trained dictionary, or the plain texts where there are too few to train one; its bytes and kind."""
    samples = [b for t in texts if t for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes(), zstandard.DICT_TYPE_FULLDICT
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICT_BYTES:] or b"\n" * 8, zstandard.DICT_TYPE_RAWCONTENT


def _sizes(texts: Iterable[bytes], *dictionaries: tuple[bytes, int]) -> np.ndarray:
    """Rows of (size with the good, with the bad dictionary, plain size) of whole texts."""
    made = [zstandard.ZstdCompressionDict(d, dict_type=k) for d, k in dictionaries]
    for d in made:
        d.precompute_compress(level=LEVEL)
    with_good, with_bad = (zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False,
                                                    write_checksum=False) for d in made)
    rows = []
    for text in texts:
        blocks = _blocks(text)
        rows.append([sum(len(c.compress(b)) for b in blocks) for c in (with_good, with_bad)] + [len(text)])
    return np.array(rows, float).reshape(-1, 3)


def _features(sizes: np.ndarray) -> np.ndarray:
    """The normalised difference, with the two ratios and the length (up to a block) that set its scale."""
    good, bad, n = sizes.T
    gap = (bad - good) / np.maximum(np.maximum(bad, good), 1)
    return np.stack([gap, gap * np.abs(gap), good / (n + 16), bad / (n + 16), np.log1p(np.minimum(n, BLOCK))], axis=1)


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries (raw or trained, as bytes and kind) and the calibration; small enough to ship with a task."""

    good: tuple[bytes, int]
    bad: tuple[bytes, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, texts: Iterable[bytes]) -> np.ndarray:
        if not len(self.good[0]):
            return np.array([float(self.weights[0]) for _ in texts])
        x = (_features(_sizes(texts, self.good, self.bad)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)

    def loss(w: np.ndarray) -> float:
        return weight @ np.logaddexp(0, (1 - 2 * y) * (a @ w)) + ridge / 2 * (w @ w)

    for _ in range(60):  # Newton steps, halved while they overshoot
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a.T * (weight * (p * (1 - p) + 1e-9))) @ a + ridge * np.eye(len(w)), a.T @ (weight * (p - y)) + ridge * w)
        while loss(w - step) > loss(w) and np.abs(step).max() >= 1e-8:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _constant(share: float) -> CompressionModel:
    return CompressionModel((b"", 0), (b"", 0), np.zeros(0), np.ones(0), np.array([share]))


def _cut(n: int) -> int:
    """How many of a class's n examples build its dictionary."""
    return max(1, int(n * DICT_SHARE))


def _calibrated(dictionaries: list[tuple[bytes, int]], sizes: list[np.ndarray], totals: list[float]) -> CompressionModel:
    """Model of the dictionaries and of the sizes of calibrating texts, good and bad ones.

    The texts of a class weigh together as many as the class has (totals), however few stand for it.
    """
    x = _features(np.concatenate(sizes))
    y = np.repeat([1.0, 0.0], [len(s) for s in sizes])
    weight = np.repeat([t / len(s) for t, s in zip(totals, sizes)], [len(s) for s in sizes])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return CompressionModel(*dictionaries, mean, scale, _logistic((x - mean) / scale, y, weight / weight.mean()))


def fit(examples: list[tuple[bytes, int]]) -> CompressionModel:
    """Model of (text, label) pairs; where a class is missing the score is label 1's share (0.5 of nothing)."""
    parts = [[t for t, y in examples if y == label] for label in (1, 0)]
    if not all(parts):
        return _constant(float(np.mean([y for _, y in examples])) if examples else 0.5)
    dictionaries = [_dictionary(p[:_cut(len(p))]) for p in parts]
    return _calibrated(dictionaries, [_sizes(p[_cut(len(p)):] or p, *dictionaries) for p in parts], [len(p) for p in parts])


def _dictionary_of_class(rows: pa.Table) -> pa.Table:
    texts = rows.sort_by([("__h", "ascending"), ("__id", "ascending")])["__text"]
    data, kind = _dictionary(t.as_py() for t in texts)
    return pa.table({"label": pa.array([rows["__label"][0].as_py()], pa.int32()), "data": pa.array([data], pa.binary()),
                     "kind": pa.array([kind], pa.int32())})


def _sizes_column(dictionaries: list[tuple[bytes, int]], text: Column) -> Column:

    @F.arrow_udf("array<double>")
    def sizes(texts: pa.Array) -> pa.Array:
        return pa.array(_sizes((t.as_py() for t in texts), *dictionaries).tolist(), pa.list_(pa.float64()))

    return sizes(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          per_class: int = PER_CLASS) -> CompressionModel:
    """Model of a bounded sample of labelled rows that aren't held out.

    For each class the ``per_class`` ids lowest by hash, with their whole texts: tasks build the
    dictionaries and take the sizes, the driver gets ids, dictionaries and sizes only. All labels
    of a class are counted, so that the share of good texts isn't that of the sample.
    """
    ids = labels.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__label in (0, 1)").distinct()
    counted = {r["__label"]: r["count"] for r in ids.groupBy("__label").count().collect()}
    picked = None
    for label in (1, 0):
        part = ids.where(F.col("__label") == label).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).alias("__own"), text_of(text_col).cast("binary").alias("__text"))
    sample = checkpointed(texts.join(F.broadcast(picked), F.col("__own") == F.col("__id"))
                          .select("__id", "__label", F.xxhash64("__id").alias("__h"), "__text")
                          .dropDuplicates(["__id", "__label"]))
    keys = [[(r["__h"], r["__id"]) for r in rows] for rows in (
        sample.where(F.col("__label") == label).select("__h", "__id").orderBy("__h", "__id").collect() for label in (1, 0))]
    if not all(keys):
        return _constant(len(keys[0]) / sum(map(len, keys)) if any(keys) else 0.5)
    building = calibrating = F.lit(False)
    for label, k in zip((1, 0), keys):
        own, (h, last) = F.col("__label") == label, k[_cut(len(k)) - 1]
        builds = (F.col("__h") < h) | ((F.col("__h") == h) & (F.col("__id") <= last))
        building = building | (own & builds)
        calibrating = calibrating | (own & ~builds if len(k) > _cut(len(k)) else own)
    made = {r["label"]: (bytes(r["data"]), r["kind"]) for r in sample.where(building).groupBy("__label")
            .applyInArrow(_dictionary_of_class, "label int, data binary, kind int").collect()}
    dictionaries = [made[1], made[0]]
    sizes = sample.where(calibrating).select("__label", "__h", "__id", _sizes_column(dictionaries, F.col("__text")).alias("sizes"))
    rows = sizes.orderBy("__h", "__id").select("__label", "sizes").collect()
    # labels without a document don't count: the share of the picked ids that were found holds for all
    totals = [counted[label] * len(k) / min(counted[label], per_class) for label, k in zip((1, 0), keys)]
    return _calibrated(dictionaries, [np.array([r["sizes"] for r in rows if r["__label"] == label], float) for label in (1, 0)], totals)


def score_column(model: CompressionModel, text: Column) -> Column:
    """Probability of label 1 for whole texts."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score((t.as_py() for t in texts.cast(pa.binary()))), pa.float64())

    return score(text)


def classify(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row; a null text scores as an empty one."""
    scored = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), score_column(model, text_of(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: CompressionModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier accepts, with their columns."""
    return docs.where(score_column(model, text_of(text_col)) >= threshold)
