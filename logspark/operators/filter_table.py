"""any number of saved filters, kept as a table, evaluated in one pass by counting.

A filter is a set of conditions, one row each: (name, part, kind, facet, value, low, high).
Conditions of one part are alternatives, a filter's parts must all hold, and it must hit none
of its exclusions. Events become (facet, value) pairs, which meet the conditions in an equality
join; an event passes a filter when the number of parts it hit is the filter's. Numeric ranges
are cut into dyadic intervals, and an event's number names the interval of every width that it
lies in, so ranges meet numbers by equality too. An event is paired only with the filters of which
it hits the leading part, the one that the fewest events can hit; all other conditions are checked
for those pairs alone, so that a broad condition (a level, an exclusion) costs nothing by itself.
The number of filters never enters the plan.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators import filters as FI
from logspark.schema import LEVELS
from logspark.session import stored

CONDITIONS = "name string, part int, kind string, facet string, value string, low double, high double, problem string"
#: Powers of two of the interval widths; wider ranges take several of the widest.
WIDTHS = tuple(range(-6, 50, 4))
#: Numeric event columns that a range may name; the time counts in milliseconds.
RANGES = {"duration_ms": "duration_ms", "timestamp": "unix_millis(timestamp)"}


def conditions(name: str, state: FI.FilterState) -> list[tuple]:
    """A filter's rows: facet selections, minimum level, correlation, ranges on duration and time.

    A predicate that can't be read makes the filter invalid: one row with its problem. Other
    predicates and text search aren't kinds of this table (ValueError); ``evaluate_saved_filters``
    takes those.
    """
    if state.text.strip():
        raise ValueError("a table of filters holds no text search")
    good, problems = FI.validate_predicates(state.predicates, state.now_ms)
    if problems:
        return [(name, 0, "invalid", None, None, None, None, "; ".join(problems))]
    rows, part = [], 0
    row = lambda part, kind, facet, value=None, low=None, high=None: rows.append((name, part, kind, facet, value, low, high, None))
    for facet in state.active_facets():
        include, exclude = state.selection(facet)
        for value in include:
            row(part, "include", facet, value)
        part += bool(include)
        for value in exclude:
            row(-1, "exclude", facet, value)
    levels = LEVELS[LEVELS.index(state.minimum_level):] if state.minimum_level else []
    if levels:
        for value in levels:
            row(part, "include", "level", value)
        part += 1
    if state.correlation is not None:
        row(part, "include", "correlation", state.correlation)
        part += 1
    bounds: dict[str, list[float]] = {}
    for p in good:
        if p.field not in RANGES or p.operator not in (">", ">=", "<", "<="):
            raise ValueError(f"a table of filters holds no predicate like {p.label!r}")
        low, high = bounds.setdefault(p.field, [-math.inf, math.inf])
        value = float(p.literal)
        if p.operator in (">", ">="):
            bounds[p.field][0] = max(low, math.nextafter(value, math.inf) if p.operator == ">" else value)
        else:
            bounds[p.field][1] = min(high, math.nextafter(value, -math.inf) if p.operator == "<" else value)
    for field, (low, high) in bounds.items():
        row(part, "range", field, None, low, high)
        part += 1
    if not part:  # every event has a level: a filter of exclusions only starts from all events
        for value in LEVELS:
            row(0, "include", "level", value)
    return rows


def filter_table(spark: SparkSession, filters: dict[str, FI.FilterState]) -> DataFrame:
    """The rows of named filters; a table of this shape may as well come from storage."""
    return spark.createDataFrame([r for name, state in filters.items() for r in conditions(name, state)], CONDITIONS)


_FAR = 2.0**52  # numbers beyond lie in the outermost intervals


def _block(number: Column, width: int) -> Column:
    return F.floor(F.greatest(F.least(number, F.lit(_FAR)), F.lit(-_FAR)) / F.lit(2.0**width)).cast("long")


def _cover(low: Column, high: Column) -> Column:
    """Intervals (width 2^w, number) that cover a range: the narrowest width of which a few suffice."""
    def of(width: int) -> Column:
        return F.transform(F.sequence(_block(low, width), _block(high, width)), lambda b: F.struct(F.lit(width).alias("width"), b.alias("block")))

    none = F.array().cast("array<struct<width:int,block:bigint>>")
    out = F.when(~(low <= high), none)
    for width in WIDTHS[:-1]:
        out = out.when(_block(high, width) - _block(low, width) < 32, of(width))
    return out.otherwise(of(WIDTHS[-1]))


def _values(events: DataFrame, facets: list[str], fields: list[str]) -> DataFrame:
    """(event_id, pairs, numbers): what an event holds of the facets and of the numbers that some filter names."""
    stored_columns = tuple(events.columns)
    pairs = F.array(*(F.struct(F.lit(f).alias("facet"), FI.facet_value(f, stored_columns).cast("string").alias("value")) for f in facets))
    numbers = F.array(*(F.struct(F.lit(f).alias("facet"), F.expr(RANGES[f]).cast("double").alias("number")) for f in fields))
    return events.select("event_id", (pairs if facets else F.array().cast("array<struct<facet:string,value:string>>")).alias("pairs"),
                         (numbers if fields else F.array().cast("array<struct<facet:string,number:double>>")).alias("numbers"))


def _pairs(values: DataFrame, facets: list[str], *keep: str) -> DataFrame:
    """(keep, facet, value) of some of the facets."""
    some = F.filter("pairs", lambda p: p["value"].isNotNull() & p["facet"].isin(facets))
    return values.select(*keep, F.explode(some).alias("p")).select(*keep, "p.*")


def _numbers(values: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    """(keep, facet, number) of some of the numeric fields."""
    some = F.filter("numbers", lambda p: p["number"].isNotNull() & ~F.isnan(p["number"]) & p["facet"].isin(fields))
    return values.select(*keep, F.explode(some).alias("p")).select(*keep, "p.*")


def _blocks(numbers: DataFrame) -> DataFrame:
    """Numbers with (width, block) of every interval that they lie in."""
    blocks = F.array(*(F.struct(F.lit(w).alias("width"), _block(F.col("number"), w).alias("block")) for w in WIDTHS))
    return numbers.withColumn("b", F.explode(blocks)).select(*numbers.columns, "b.*")


def _covers(ranges: DataFrame) -> DataFrame:
    return ranges.select("*", F.explode(_cover(F.col("low"), F.col("high"))).alias("b")).select(*ranges.columns, "b.*")


def _leads(values: DataFrame, wanted: DataFrame, ranges: DataFrame, named: dict[str, list[str]]) -> DataFrame:
    """(name, part): of each filter the part that the fewest events can hit, counted by its values and intervals."""
    found = []
    if "value" in named:
        keys = wanted.select("facet", "value").distinct()
        sizes = _pairs(values, named["value"]).join(keys, ["facet", "value"], "left_semi").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
        found.append(wanted.where("part >= 0").join(sizes, ["facet", "value"], "left").select("name", "part", "n"))
    if "range" in named:
        covers = _covers(ranges.where("part >= 0"))
        keys = covers.select("facet", "width", "block").distinct()
        sizes = _blocks(_numbers(values, named["range"])).join(keys, ["facet", "width", "block"], "left_semi").groupBy(
            "facet", "width", "block").agg(F.count(F.lit(1)).alias("n"))
        found.append(covers.join(sizes, ["facet", "width", "block"], "left").select("name", "part", "n"))
        found.append(ranges.where("part >= 0").select("name", "part", F.lit(0).cast("long").alias("n")))  # an empty range has no interval
    sizes = reduce(DataFrame.unionByName, found).groupBy("name", "part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return sizes.groupBy("name").agg(F.min_by("part", F.struct("n", "part")).alias("part"))


def _hits(values: DataFrame, wanted: DataFrame, ranges: DataFrame, named: dict[str, list[str]]) -> DataFrame:
    """(event_id, name, part): the parts and exclusions that an event hits of the filters whose leading part it hits."""
    leads = stored(_leads(values, wanted, ranges, named), "saved-filter-leads")
    first, within = (rows.join(leads, ["name", "part"], "left_semi") for rows in (wanted, ranges))
    leading = {kind: sorted(r[0] for r in rows.select("facet").distinct().collect()) for kind, rows in (("value", first), ("range", within))}
    keep, found = ("event_id", "pairs", "numbers"), []
    if leading["value"]:
        found.append(_pairs(values, leading["value"], *keep).join(first.select("name", "facet", "value"), ["facet", "value"]).select(*keep, "name"))
    if leading["range"]:
        covers = _covers(within.select("name", "facet", "low", "high"))
        inside = _blocks(_numbers(values, leading["range"], *keep)).join(covers, ["facet", "width", "block"])
        found.append(inside.where("number between low and high").select(*keep, "name"))
    if not found:  # only exclusions
        return wanted.select(F.lit(None).cast("long").alias("event_id"), "name", "part").limit(0)
    met, hits = reduce(DataFrame.unionByName, found), []
    if "value" in named:
        hits.append(_pairs(met, named["value"], "event_id", "name").join(wanted, ["name", "facet", "value"]).select("event_id", "name", "part"))
    if "range" in named:
        numbers = _numbers(met, named["range"], "event_id", "name").join(ranges, ["name", "facet"])
        hits.append(numbers.where("number between low and high").select("event_id", "name", "part"))
    return reduce(DataFrame.unionByName, hits)


def evaluate(events: DataFrame, table: DataFrame) -> DataFrame:
    """per filter of the table: hits, first and last event id, errors; filters that nothing passes too."""
    table = stored(table, "saved-filters")
    named = {r["kind"]: sorted(r["facets"]) for r in table.where("facet is not null").groupBy(
        F.when(F.col("kind") == "range", "range").otherwise("value").alias("kind")).agg(F.collect_set("facet").alias("facets")).collect()}
    wanted = table.where("kind in ('include', 'exclude')").select("name", "part", "facet", "value").distinct()
    ranges = table.where("kind = 'range'").select("name", "part", "facet", "low", "high").distinct()
    hits = _hits(_values(events, named.get("value", []), named.get("range", [])), wanted, ranges, named) if named else None
    filters = table.groupBy("name").agg(F.coalesce(F.max("part"), F.lit(0)).alias("last"), F.max("problem").alias("errors"),
                                        F.max(F.when(F.col("kind") == "invalid", 1).otherwise(0)).alias("invalid"))
    if hits is None:
        counts = filters.select("name").limit(0).withColumns({c: F.lit(None).cast("long") for c in ("hits", "first_event_id", "last_event_id")})
    else:
        reached = hits.groupBy("name", "event_id").agg(F.count_distinct(F.when(F.col("part") >= 0, F.col("part"))).alias("parts"), F.min("part").alias("least"))
        passed = reached.where("least >= 0").join(filters, "name").where("parts = last + 1")
        counts = passed.groupBy("name").agg(F.count(F.lit(1)).alias("hits"), F.min("event_id").alias("first_event_id"), F.max("event_id").alias("last_event_id"))
    return filters.join(counts, "name", "left").select("name", F.coalesce("hits", F.lit(0)).alias("hits"), "first_event_id", "last_event_id", "errors")
