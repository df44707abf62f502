import math
import random

import pytest

from logspark.operators import filter_table as FT
from logspark.operators import filters as FI
from logspark.operators import saved as SV
from tests.conftest import event, frame


def _events(spark, n=200):
    rng = random.Random(3)
    rows = [event(i, level=rng.choice(["trace", "info", "warn", "error", "fatal"]), source=rng.choice(["a", "b", "c"]), provider=rng.choice([None, "", "p", "q"]),
                  request_id=rng.choice([None, "r1", "r2"]), duration_ms=rng.choice([None, 0.0, 0.25, 5.0, 99.5, 1e7, 1e18]),
                  fields=f'{{"user": "u{i % 7}", "n": {i % 3}}}') for i in range(n)]
    return frame(spark, rows)


def _filters():
    F = FI.FilterState
    out = {
        "level": F(minimum_level="error"), "all": F(), "nothing": F(facets={"source": {"include": ["zzz"]}}),
        "alternatives": F(facets={"source": {"include": ["a", "b"]}, "provider": {"include": ["p"]}}),
        "excluded only": F(facets={"provider": {"exclude": ["p"]}, "source": {"exclude": ["c"]}}),
        "both": F(facets={"fields.user": {"include": ["u1", "u2"], "exclude": ["u2"]}}),
        "correlation": F(correlation="r1", minimum_level="warn"),
        "open range": F(predicates=[("duration_ms", ">", "0")]), "shut range": F(predicates=[("duration_ms", ">=", "0.25"), ("duration_ms", "<=", "99.5")]),
        "strict": F(predicates=[("duration_ms", ">", "0.25"), ("duration_ms", "<", "99.5")]), "empty range": F(predicates=[("duration_ms", ">", "5"), ("duration_ms", "<", "5")]),
        "huge": F(predicates=[("duration_ms", ">=", "1e17")]), "time": F(predicates=[("timestamp", ">=", "2024-01-01T00:00:50Z"), ("timestamp", "<", "2024-01-01T00:02:00Z")]),
        "broken": F(predicates=[("level", ">", "warn")]), "number field": F(facets={"fields.n": {"include": ["2"]}, "level": {"include": ["info", "warn"]}}),
    }
    return out


def test_a_table_of_filters_equals_evaluating_each(spark):
    df, filters = _events(spark), _filters()
    want = {r.name: tuple(r) for r in SV.evaluate_saved_filters(df, filters).select("name", "hits", "first_event_id", "last_event_id", "errors").collect()}
    got = {r.name: tuple(r) for r in FT.evaluate(df, FT.filter_table(spark, filters)).collect()}
    assert got == want and want["all"][1] == 200 and want["broken"][4]
    only = {k: filters[k] for k in ("shut range",)}
    assert [tuple(r) for r in FT.evaluate(df, FT.filter_table(spark, only)).collect()] == [want["shut range"]]
    assert FT.evaluate(df.limit(0), FT.filter_table(spark, filters)).where("hits > 0").count() == 0
    broken = FT.evaluate(df, FT.filter_table(spark, {"broken": filters["broken"]})).collect()
    assert [tuple(r) for r in broken] == [want["broken"]]


def test_what_a_table_can_t_hold_is_refused():
    for state in (FI.FilterState(text="x"), FI.FilterState(predicates=[("message", "=", "x")]), FI.FilterState(predicates=[("duration_ms", "=", "5")])):
        with pytest.raises(ValueError):
            FT.conditions("f", state)


def test_intervals_cover_ranges(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        a, b = sorted(rng.choice([-1, 1]) * 10 ** rng.uniform(-4, 16) for _ in range(2))
        rows.append((i, a if rng.random() < 0.9 else -math.inf, b if rng.random() < 0.9 else math.inf))
    df = spark.createDataFrame(rows, "i int, low double, high double")
    from pyspark.sql import functions as F

    for r in df.select("*", FT._cover(F.col("low"), F.col("high")).alias("c")).collect():
        blocks = [(c["width"], c["block"]) for c in r["c"]]
        assert 1 <= len(blocks) <= 140 and len({w for w, _ in blocks}) == 1
        w = blocks[0][0]
        for x in (r["low"], r["high"]):
            assert (w, math.floor(max(-2.0**52, min(2.0**52, x)) / 2.0**w)) in blocks


def test_many_filters_share_one_plan(spark):
    df = _events(spark)
    plans = [FT.evaluate(df, FT.filter_table(spark, {f"f{i}": FI.FilterState(facets={"fields.user": {"include": [f"u{i}"]}}) for i in range(n)}))
             ._jdf.queryExecution().executedPlan().toString() for n in (3, 300)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines()) and "CartesianProduct" not in plans[1] and "NestedLoop" not in plans[1]


def test_broad_conditions_pair_no_events(spark):
    """Only the leading part makes pairs: 300 filters on every event's level, each with one user, give a pair an event and user."""
    rows = [event(i, level="error", source="a", fields=f'{{"user": "u{i}"}}') for i in range(300)]
    df = frame(spark, rows + [event(7, level="info", source="a", fields='{"user": "u7"}')])
    filters = {f"f{i:03d}": FI.FilterState(facets={"fields.user": {"include": [f"u{i}"]}, "source": {"exclude": ["b"]}}, minimum_level="warn",
                                           predicates=[("timestamp", ">=", "2024-01-01T00:00:00Z")]) for i in range(300)}
    table = FT.filter_table(spark, filters)
    wanted = table.where("kind in ('include', 'exclude')").select("name", "part", "facet", "value").distinct()
    ranges = table.where("kind = 'range'").select("name", "part", "facet", "low", "high")
    named = {"value": ["fields.user", "level", "source"], "range": ["timestamp"]}
    hits = FT._hits(FT._values(df, named["value"], named["range"]), wanted, ranges, named)
    assert hits.count() <= 3 * 301  # user, level and time of one filter an event, not of all 300
    got = {r.name: tuple(r)[1:4] for r in FT.evaluate(df, table).collect()}
    assert got == {f"f{i:03d}": (1, i, i) for i in range(300)}
