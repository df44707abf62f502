"""Filter interaction audit: what each filter removes, in every order in which filters may run.

Filters that a document fails are the bits of its mask; all the audit needs is how many
documents of a part have each mask. The states of the audit are the subsets of filters already
applied; an edge applies one more, and removes the documents that pass the state's filters and
fail the edge's. Path counts, forward from the empty set and backward from the full one, say in
how many orders an edge is used: its removals times both counts, summed over a filter's edges,
are the removals of the filter over all orders. The steps of each order are read from the same
edges.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import WORD_PATTERN, text_of

MAX_FILTERS = 6  # 720 orders; the lattice of k filters has 2^k states and k * 2^(k-1) edges


@dataclass(frozen=True)
class Edge:
    """A filter applied in a state, the orders through it and how many those are."""

    state: int
    bit: int
    orders: tuple[str, ...]
    paths: int


def lattice(names: str) -> list[Edge]:
    """The edges of the subset lattice of filters (one letter each), with forward times backward path counts."""
    k = len(names)
    if not 1 <= k <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters")
    full = (1 << k) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for s in range(full + 1):
        for i in range(k):
            if not s >> i & 1:
                forward[s | 1 << i] += forward[s]
    for s in range(full, -1, -1):
        for i in range(k):
            if s >> i & 1:
                backward[s ^ 1 << i] += backward[s]
    through: dict[tuple[int, int], list[str]] = {}
    for order in permutations(names):
        state = 0
        for name in order:
            bit = 1 << names.index(name)
            through.setdefault((state, bit), []).append("".join(order))
            state |= bit
    return [Edge(s, b, tuple(orders), forward[s] * backward[s | b]) for (s, b), orders in sorted(through.items())]


def _repeats(rows: DataFrame, bit: int) -> DataFrame:
    """``bit`` set for rows whose text some smaller id has; (part, mask, good, toxic, n) of all rows.

    Rows of one text, part, mask and marks are summed before they meet, so a text that a third
    of all rows share comes down to a few sums; no text is gathered.
    """
    own = ["k1", "k2", "part", "mask", "good", "toxic"]
    named = rows.groupBy("id", *own).agg(F.count(F.lit(1)).alias("n"))
    sums = named.groupBy(*own).agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_low"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"))
    first = F.min("low").over(Window.partitionBy("k1", "k2"))
    stay = F.col("unnamed") + F.when(F.col("low") == first, F.col("n_low")).otherwise(F.lit(0))
    split = F.array(F.struct("mask", F.col("stay").alias("n")), F.struct((F.col("mask") + F.lit(bit)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    return sums.withColumn("stay", stay).select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "s.mask", "good", "toxic", "s.n").where("n > 0")


def failure_counts(docs: DataFrame, filters: dict[str, Column], repeats: str | None = None, marks: DataFrame | None = None,
                   id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows of a part that fail just the filters in the mask.

    ``filters`` names boolean columns, true where a row fails (null: it passes); bits follow
    their order, then ``repeats``: that filter fails rows whose text a smaller id has. Rows
    without an id neither fail it nor fail others; rows that repeat an id and text don't fail
    for each other. ``marks`` (id, good, toxic) may name an id often: one true mark suffices;
    a null id has none. A null text counts as empty, a null part as the part of empty strings.
    """
    failed = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())), F.lit(0))
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failed.alias("mask"),
                       F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    no = F.lit(False)
    if marks is None:
        rows = rows.withColumns({"good": no, "toxic": no})
    else:
        own = marks.groupBy(F.col("id").alias("marked")).agg(*(F.max(F.coalesce(F.col(c), no)).alias(c) for c in ("good", "toxic")))
        rows = (rows.join(own, F.col("id") == F.col("marked"), "left").drop("marked")
                .withColumns({c: F.coalesce(c, no) for c in ("good", "toxic")}))
    rows = _repeats(rows, 1 << len(filters)) if repeats else rows.withColumn("n", F.lit(1).cast("long"))
    marked = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def audit(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order and step from (part, mask, n, good, toxic); zeros included.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. A part has a row a mask at most, so its work is bounded by the lattice.
    """
    edges = lattice(names)
    entries = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries")
    edge = F.array(*(F.struct(F.lit(e.state).alias("state"), F.lit(e.bit).alias("bit"), F.lit(e.paths).cast("long").alias("paths"),
                              F.array(*map(F.lit, e.orders)).alias("orders")) for e in edges))
    rows = counts.groupBy("part").agg(entries).select("part", "entries", F.explode(edge).alias("e")).select("part", "entries", "e.*")

    def total(field: str, chosen) -> Column:
        picked = F.filter("entries", lambda m: chosen(m["mask"]))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda s, m: s + m[field])

    state, bit = F.col("state"), F.col("bit")
    fails, alive = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(state) == 0
    rows = rows.select(
        "part", "state", "bit", "paths", "orders", total("n", lambda m: alive(m) & ~fails(m)).alias("kept"),
        *(total(f, lambda m: alive(m) & fails(m)).alias(name) for f, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))),
        total("n", lambda m: ~alive(m) & fails(m)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"))
    shapley = F.sum(F.col("paths") * F.col("removed")).over(Window.partitionBy("part", "bit"))
    steps = rows.withColumn("shapley", shapley).withColumn("step", (F.bit_count("state") + 1).cast("int"))
    return steps.select("part", F.explode("orders").alias("filter_order"), "step", "kept", "removed", "redundant", "unique_fails",
                        "good_lost", "toxic_lost", "shapley")


def quality_filters(text: Column) -> dict[str, Column]:
    """Few words, few different words, many capitals, mark-up symbols; true where a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    length, n = F.char_length(text), F.size(words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n * 80,
        "C": (length - F.char_length(F.regexp_replace(text, "[A-Z]", ""))) * 100 > length * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }
