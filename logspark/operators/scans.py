"""Scans over ordered block tables: running sums and nearest values, in two sweeps.

Rows are cut into blocks elsewhere; here is one row a block, and still there may be millions.
The table is range-partitioned by the order of its blocks and stored with the number of each
range. A sweep inside every range works by windows that end with the range; one value a range
goes up, is combined over the ranges (no more of them than shuffle partitions), and comes
down again to every block. So no window holds more than a range, whatever the data's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.session import checkpointed

RANGE = "_range"


def in_ranges(blocks: DataFrame, order: list[str]) -> DataFrame:
    """``blocks`` range-partitioned by ``order`` and stored, with the number of each row's range."""
    return checkpointed(blocks.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def _by_range(values: dict[int, int | None]) -> Column:
    """The value of a row's range, from one value a range."""
    out = F.lit(None).cast("long")
    if values:
        out = F.array(*(F.lit(values.get(i)).cast("long") for i in range(max(values) + 1)))[F.col(RANGE)]
    return out


def running_sums(blocks: DataFrame, within: list[str], marks: list[str], size: str, name: str) -> DataFrame:
    """``blocks`` with ``name``: the sum of ``size`` over earlier blocks (order ``marks``) of the ``within`` group."""
    rows = in_ranges(blocks, [*within, *marks])
    inside = Window.partitionBy(*within, RANGE).orderBy(*marks).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(size).over(inside), F.lit(0))
    totals = rows.groupBy(*within, RANGE).agg(F.sum(size).alias("_total"))
    if not within:
        found, before, total = dict(totals.collect()), {}, 0
        for r in sorted(found):
            before[r], total = total, total + found[r]
        return rows.withColumn(name, own + F.coalesce(_by_range(before), F.lit(0))).drop(RANGE)
    ahead = Window.partitionBy(*within).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).drop("_total")
    return _joined(rows.withColumn("_own", own), totals, within).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", RANGE)


def _joined(rows: DataFrame, totals: DataFrame, within: list[str]) -> DataFrame:
    """``rows`` with the values of their group and range; group columns may be null."""
    renamed = totals.withColumnsRenamed({c: f"_k_{c}" for c in (*within, RANGE)})
    same = F.col(RANGE) == F.col(f"_k_{RANGE}")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(renamed, same).drop(*(f"_k_{c}" for c in (*within, RANGE)))


def nearest(blocks: DataFrame, within: list[str], mark: str, first: str, last: str) -> DataFrame:
    """``blocks`` with ``_next`` (the ``first`` of the nearest later block that has one), ``_prev`` (the ``last`` of
    the nearest earlier one), ``_low`` and ``_high`` (of the whole group). Ids grow with the blocks."""
    rows = in_ranges(blocks, [*within, mark])
    inside = Window.partitionBy(*within, RANGE).orderBy(mark)
    after, before = inside.rowsBetween(1, Window.unboundedFollowing), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_after": F.min(first).over(after), "_before": F.max(last).over(before)})
    ends = rows.groupBy(*within, RANGE).agg(F.min(first).alias("_first"), F.max(last).alias("_last"))
    if not within:
        found = {r[RANGE]: (r["_first"], r["_last"]) for r in ends.collect()}
        later, earlier, low, high = {}, {}, None, None
        for r in sorted(found):
            earlier[r], high = high, found[r][1] if found[r][1] is not None else high
        for r in sorted(found, reverse=True):
            later[r], low = low, found[r][0] if found[r][0] is not None else low
        rows = rows.withColumns({"_later": _by_range(later), "_earlier": _by_range(earlier), "_low": F.lit(low).cast("long"), "_high": F.lit(high).cast("long")})
    else:
        over = Window.partitionBy(*within).orderBy(RANGE)
        whole = Window.partitionBy(*within)
        ends = ends.select(*within, RANGE, F.min("_first").over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
                           F.max("_last").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
                           F.min("_first").over(whole).alias("_low"), F.max("_last").over(whole).alias("_high"))
        rows = _joined(rows, ends, within)
    return rows.select(*within, mark, F.coalesce("_after", "_later").alias("_next"), F.coalesce("_before", "_earlier").alias("_prev"), "_low", "_high")
