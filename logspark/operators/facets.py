"""Facet counting.

``facet_counts_all`` answers every facet in ONE scan and ONE aggregation: each row carries
the list of facet selections it fails; a row failing none counts for every facet, a row
failing exactly one counts only for that facet (its own selection is ignored for its own
counts), a row failing two or more is dropped before the shuffle. The (facet, value)
pairs then go through a hash aggregate with map-side partial counts, so a hot value (one
level holding a third of all rows) never concentrates rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions import columns as C
from logspark.operators.filters import FilterState, facet_condition, facet_value, filter_column
from logspark.schema import PRIMARY_FACETS

# Facets every event is indexed under: the primary list plus the optional session id.
INDEXED_FACETS = PRIMARY_FACETS + ["session_id"]


def _without_facets(state: FilterState) -> FilterState:
    return FilterState(facets={}, minimum_level=state.minimum_level, correlation=state.correlation,
                       text=state.text, predicates=state.predicates, now_ms=state.now_ms)


def facet_pairs(df: DataFrame, facets: list[str] | None = None, include_fields: bool = True) -> Column:
    """ARRAY<STRUCT<facet, value>> of the values a row contributes (A3), NULL values dropped."""
    names = facets if facets is not None else INDEXED_FACETS
    fixed = [F.struct(F.lit(f).alias("facet"), facet_value(f, tuple(df.columns)).alias("value")) for f in names
             if not f.startswith("fields.")]
    arr = F.array(*fixed) if fixed else F.array().cast("array<struct<facet:string,value:string>>")
    if include_fields:
        wanted = None if facets is None else [f for f in facets if f.startswith("fields.")]
        entries = F.transform(
            F.filter(C.field_entries("fields"), lambda e: e["text"].isNotNull()),
            lambda e: F.struct(F.concat(F.lit("fields."), e["key"]).alias("facet"),
                               e["text"].alias("value")))
        if wanted is not None:
            entries = F.filter(entries, lambda e: e["facet"].isin(wanted)) if wanted else None
        if entries is not None:
            arr = F.concat(arr, entries)
    return F.filter(arr, lambda p: p["value"].isNotNull())


def facet_values(df: DataFrame, facets: list[str] | None = None) -> DataFrame:
    """A3: one row per (event, facet, value) the event is indexed under."""
    return (df.select("event_id", F.explode(facet_pairs(df, facets)).alias("p"))
              .select("event_id", F.col("p.facet").alias("facet"), F.col("p.value").alias("value")))


def facet_counts_all(df: DataFrame, state: FilterState | None = None,
                     facets: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """A2: (facet, value, count) under every filter except the facet's own selection."""
    state = state or FilterState()
    stored = tuple(df.columns)
    base = df.where(filter_column(_without_facets(state), stored=stored))
    active = state.active_facets()
    if active:
        def fails_facet(f):
            value = F.col(f) if f in ("tag", "correlation") and f in stored else None
            # a row lacking an included facet fails it: the condition is null there
            return ~F.coalesce(facet_condition(f, *state.selection(f), value=value), F.lit(False))
        fails = F.filter(F.array(*[F.when(fails_facet(f), F.lit(f)) for f in active]), lambda x: x.isNotNull())
    else:
        fails = F.array().cast("array<string>")
    rows = base.select(fails.alias("_fails"), *[c for c in df.columns])
    rows = rows.where(F.size("_fails") <= 1)
    pairs = rows.select(F.col("_fails"), F.explode(facet_pairs(rows, facets)).alias("p"))
    counted = (pairs.where((F.size("_fails") == 0) | (F.get(F.col("_fails"), 0) == F.col("p.facet")))
                    .groupBy(F.col("p.facet").alias("facet"), F.col("p.value").alias("value"))
                    .agg(F.count(F.lit(1)).alias("count")))
    if ordered:
        counted = counted.orderBy(F.col("facet"), F.col("count").desc(), F.col("value"))
    return counted


def facet_counts(df: DataFrame, facet: str, state: FilterState | None = None) -> DataFrame:
    """A1: value counts of one facet; count > 0; count desc, value asc."""
    state = state or FilterState()
    own = {f: s for f, s in state.facets.items() if f != facet}
    other = FilterState(facets=own, minimum_level=state.minimum_level, correlation=state.correlation,
                        text=state.text, predicates=state.predicates, now_ms=state.now_ms)
    stored = tuple(df.columns)
    return (df.where(filter_column(other, stored=stored))
              .select(facet_value(facet, stored).alias("value")).where(F.col("value").isNotNull())
              .groupBy("value").agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col("value")))


def discover_field_facets(df: DataFrame, n: int = 20) -> DataFrame:
    """A4: the first ``n`` ``fields.<name>`` facets in lexicographic order (a top-n report)."""
    return (df.select(F.explode(F.filter(C.field_entries("fields"), lambda e: e["text"].isNotNull()))
                      .alias("e"))
              .select(F.concat(F.lit("fields."), F.col("e.key")).alias("facet"))
              .distinct().orderBy("facet").limit(n))


def facet_value_search(counts: DataFrame, text: str) -> DataFrame:
    """keep facet values containing ``text`` (case-insensitive)."""
    needle = text.strip().lower()
    if not needle:
        return counts
    return counts.where(F.contains(F.lower(F.col("value")), F.lit(needle)))


def top_facet_values(counts: DataFrame, n: int = 100, text: str = "") -> DataFrame:
    """At most ``n`` values per facet (count desc, value asc), after F12.

    ``row_number() <= n`` is planned as a partial per-partition top-n before the shuffle,
    so a facet with billions of values still ships at most n rows per map task.
    """
    w = Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("value"))
    return (facet_value_search(counts, text).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))
