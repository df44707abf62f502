"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule, given as knots (time 0 to 1, weight) joined by straight
lines. Its integral is the source's weight in the mix. Targets share all words by weight and
stop at a multiple of the source's size. Documents of a source are laid end to end in hash
order; the words before a document are the source's cumulative demand, and inverting the
integral of the schedule there gives its training position.

Running sums are built from sums over hash buckets and windows inside a bucket, so a source
of any size is dealt over ``BUCKETS`` groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed, text_of, word_count

#: Schedules of the sources in turn; their integrals are 1, 2 and 3.
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.0), (0.5, 3.0), (1.0, 5.0)))
CAP = 3
BUCKET_DIGITS = 3  # hex digits of the hash: 4096 buckets a source


def integral(knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def _position(share: Column, knots) -> Column:
    """The time at which a schedule's integral reaches ``share`` (0 to 1) of its whole."""
    area, done, out = integral(knots), 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        slope = (w1 - w0) / (t1 - t0)
        over = share * F.lit(area) - F.lit(done)
        root = F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * over)
        time = F.lit(t0) + F.when(F.lit(w0) + root > 0, F.lit(2.0) * over / (F.lit(w0) + root)).otherwise(F.lit(0.0))
        out = F.when(share * F.lit(area) >= F.lit(done), time) if out is None else F.when(share * F.lit(area) >= F.lit(done), time).otherwise(out)
        done += (t1 - t0) * (w0 + w1) / 2
    return out


def targets(sizes: DataFrame, curriculum=CURRICULUM, cap: int = CAP) -> DataFrame:
    """Targets of sources from (source, source_size): adds turn (from 0), weight and target.

    Sources take schedules in turn by code point, null last. Where a target would pass
    ``cap`` times the size the excess goes to the others by weight: with the sources ordered
    by the level at which they fill up, the first whose level suffices for what is left sets
    the level of all that follow. The table has a row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(integral(k))) for k in curriculum))
    t = sizes.withColumn("turn", F.pmod(F.row_number().over(order) - 1, F.lit(len(curriculum))))
    t = t.withColumn("weight", F.element_at(weights, F.col("turn") + 1)).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("rim", F.col("full") / F.col("weight"))
    filling = Window.orderBy("rim", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("full").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    t = t.withColumn("level", (whole - before) / after).withColumn("nth", F.row_number().over(filling))
    level = F.min(F.when(F.col("level") <= F.col("rim"), F.struct("nth", "level"))).over(Window.partitionBy())["level"]
    t = t.withColumn("target", F.least("full", level * F.col("weight")))
    return t.select("source", "source_size", "turn", "target")


def _laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, curriculum, cap: int, whole: bool) -> DataFrame:
    """__size, __source_size, __target, __turn, __before and __copies, with the ``whole`` row as one struct if asked for."""
    text = text_of(text_col)
    row = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if whole else []
    rows = docs.select(*row, F.col(source_col).alias("__source"), F.col(id_col).alias("__id"), word_count(text).alias("__size"),
                       F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("__hash"),
                       F.xxhash64(text).alias("__tie"))
    rows = rows.withColumn("__bucket", F.substring("__hash", 1, BUCKET_DIGITS))
    sums = checkpointed(
        docs.select(F.col(source_col).alias("__source"), word_count(text).alias("__size"),
                    F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, BUCKET_DIGITS).alias("__bucket"))
        .groupBy("__source", "__bucket").agg(F.sum("__size").alias("__words")))
    goal = targets(sums.groupBy(F.col("__source").alias("source")).agg(F.sum("__words").alias("source_size")), curriculum, cap)
    ahead = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__source", "__bucket", F.coalesce(F.sum("__words").over(ahead), F.lit(0)).alias("__start"))
    starts = starts.join(goal, F.col("__source").eqNullSafe(F.col("source"))).select(
        F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__start", F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), F.col("turn").alias("__turn"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__hash", "__id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("__run", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    laid = laid.join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    laid = laid.withColumn("__before", F.col("__start") + F.col("__run"))
    size = F.col("__source_size")
    rounds = F.when(size > 0, F.floor(F.col("__target") / size)).otherwise(F.lit(0))
    rest = F.col("__target") - rounds * size
    extra = (F.col("__before") + F.col("__size") / 2 < rest).cast("long")
    return laid.withColumn("__copies", rounds + extra)


def _time(at: Column, curriculum) -> Column:
    """Training position of a document from which its source has ``at`` words before it."""
    share = F.when(F.col("__target") > 0, at / F.col("__target")).otherwise(F.lit(0.0))
    out = F.lit(None).cast("double")
    for turn, knots in enumerate(curriculum):
        out = F.when(F.col("__turn") == turn, _position(share, knots)).otherwise(out)
    return out


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             curriculum=CURRICULUM, cap: int = CAP) -> DataFrame:
    """Per row: id, size, source_size, target, copies, taken (words) and position of the first copy (null without one).

    Sorted by position. A null text has no words; null sources are one source; rows that
    repeat an id follow each other. Documents without words are never repeated beyond their
    source's rounds and take no words.
    """
    laid = _laid_out(docs, id_col, text_col, source_col, curriculum, cap, False)
    first = F.when(F.col("__copies") > 0, _time(F.col("__before"), curriculum))
    return laid.select(F.col("__id").alias("id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                       F.col("__target").alias("target"), F.col("__copies").alias("copies"),
                       (F.col("__copies") * F.col("__size")).alias("taken"), first.alias("position")).orderBy("position", "id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        curriculum=CURRICULUM, cap: int = CAP) -> DataFrame:
    """``docs`` in training order: each row as often as the mix takes it, range-sorted by position."""
    laid = _laid_out(docs, id_col, text_col, source_col, curriculum, cap, True)
    laid = laid.where("__copies > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)).alias("__nth"))
    at = F.col("__before") + F.col("__nth") * F.col("__source_size")
    return laid.withColumn("__time", _time(at, curriculum)).orderBy("__time", "__id").select("row.*")
