from pyspark.sql import functions as F

from logspark.operators import facets as FA
from logspark.operators import filters as FI
from tests.conftest import event, frame


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def test_tri_state_facets(spark):
    df = frame(spark, [event(0, source="app"), event(1, source="backend"), event(2, source="renderer")])
    inc = FI.FilterState(facets={"source": {"include": ["app", "renderer"]}})
    exc = FI.FilterState(facets={"source": {"exclude": ["backend"]}})
    unknown = FI.FilterState(facets={"source": {"include": ["nope"]}})
    assert ids(FI.apply_filter(df, inc)) == [0, 2]
    assert ids(FI.apply_filter(df, exc)) == [0, 2]
    assert ids(FI.apply_filter(df, unknown)) == []


def test_exclude_keeps_rows_lacking_the_facet(spark):
    df = frame(spark, [event(0, provider="local"), event(1), event(2, provider="")])
    st = FI.FilterState(facets={"provider": {"exclude": ["local"]}})
    assert ids(FI.apply_filter(df, st)) == [1, 2]


def test_own_facet_counts_ignore_own_selection(spark):
    df = frame(spark, [event(0, source="app", level="info"), event(1, source="backend", level="warn"),
                       event(2, source="app", level="error")])
    st = FI.FilterState(facets={"source": {"include": ["app"]}, "level": {"include": ["warn"]}})
    counts = {(r.facet, r.value): r["count"] for r in FA.facet_counts_all(df, st).collect()}
    # source counts ignore the source selection but apply level=warn
    assert counts[("source", "backend")] == 1 and ("source", "app") not in counts
    # level counts ignore the level selection but apply source=app
    assert counts[("level", "info")] == 1 and counts[("level", "error")] == 1
    assert ("level", "warn") not in counts
    one = {r.value: r["count"] for r in FA.facet_counts(df, "level", st).collect()}
    assert one == {"info": 1, "error": 1}


def test_large_facet_select(spark):
    rows = spark.range(50000).select(
        F.col("id").alias("event_id"), F.lit(1).alias("schema_version"),
        F.timestamp_seconds(F.col("id")).alias("timestamp"), F.lit("info").alias("level"),
        F.when(F.col("id") % 5 < 2, "picked").otherwise("other").alias("source"),
        F.lit("core").alias("subsystem"), F.lit("tick").alias("event"), F.lit("m").alias("message"),
        F.lit("run").alias("app_session_id"), *[F.lit(None).cast("string").alias(c) for c in
        ["playback_session_id", "request_id", "session_id", "target", "provider", "error_kind"]],
        F.lit(None).cast("double").alias("duration_ms"), F.lit(None).cast("string").alias("status"),
        F.lit("{}").alias("fields"))
    st = FI.FilterState(facets={"source": {"include": ["picked"]}})
    assert FI.apply_filter(rows, st).count() == 20000


def test_typed_predicates_missing_status_and_fields(spark):
    df = frame(spark, [event(0, status="200", duration_ms=12.5, fields='{"region": "EU", "n": 3}'),
                       event(1, status='"ok"', duration_ms=1.0, fields='{"region": "us"}'),
                       event(2)])
    def q(*preds):
        return ids(FI.where_predicates(df, list(preds)))
    assert q(("status", "!=", "500")) == [0, 1]        # number vs parsed text; text vs text; missing -> false
    assert q(("status", "!=", "nope")) == [1]          # unparsable vs number -> false, missing -> false
    assert q(("duration_ms", ">", "2")) == [0]
    assert q(("fields.region", "=", "eu")) == [0]      # ASCII case-insensitive
    assert q(("fields.n", ">=", "3")) == [0]
    assert q(("message", "=", "M1")) == [1]
    assert q(("fields.missing", "!=", "x")) == []


def test_invalid_predicates_fail_closed(spark):
    df = frame(spark, [event(0), event(1)])
    ok, errors = FI.validate_predicates([("level", ">=", "warn"), ("bogus", "=", "1"), ("message", "=", "")])
    assert len(errors) == 3 and not ok
    assert ids(FI.where_predicates(df, [("level", ">", "warn")])) == []


def test_relative_time_predicate(spark):
    df = frame(spark, [event(0), event(100), event(200)])
    now = 1704067200000 + 150 * 1000
    # a relative value always means ">= now - n", whatever operator was written
    assert ids(FI.where_time(df, "<", "last-60s", now_ms=now)) == [100, 200]
    assert ids(FI.where_time(df, "<", "2024-01-01T00:01:40Z")) == [0]


def test_search_exact_and_typos(spark):
    df = frame(spark, [event(0, message="Connection refused by upstream"),
                       event(1, message="playback started", fields='{"codec": "h264"}'),
                       event(2, message="nothing here")])
    assert ids(FI.search(df, "upstream")) == [0]
    assert ids(FI.search(df, "upstrem")) == [0]          # 1 edit for a 7-byte term
    assert ids(FI.search(df, "conection refusd")) == [0]  # 2 edits allowed from 8 bytes
    assert ids(FI.search(df, "H264")) == [1]              # fields are searchable
    assert ids(FI.search(df, "zzz")) == []                # short terms are exact only
    assert ids(FI.search(df, "")) == [0, 1, 2]


def test_top_values_and_value_search(spark):
    df = frame(spark, [event(i, source=f"s{i % 3}") for i in range(9)])
    counts = FA.facet_counts_all(df, ordered=False)
    top = FA.top_facet_values(counts.where("facet = 'source'"), n=2)
    assert [r.value for r in top.orderBy("rank").collect()] == ["s0", "s1"]
    assert [r.value for r in FA.facet_value_search(counts.where("facet = 'source'"), "S2").collect()] == ["s2"]


def test_incremental_search_and_saved_filters(spark):
    from logspark.operators import saved as SV
    df = frame(spark, [event(i, message="cache miss" if i % 2 else "cache hit", level="error" if i == 3 else "info")
                       for i in range(6)])
    assert ids(FI.search_since(df, "miss", 2)) == [3, 5]
    res = {r.name: r for r in SV.evaluate_saved_filters(df, {
        "errors": FI.FilterState(minimum_level="error"),
        "hits": FI.FilterState(text="hit"),
        "bad": FI.FilterState(predicates=[("nope", "=", "1")]),
    }).collect()}
    assert (res["errors"].hits, res["errors"].first_event_id) == (1, 3)
    assert (res["hits"].hits, res["hits"].first_event_id, res["hits"].last_event_id) == (3, 0, 4)
    assert res["bad"].hits == 0 and "Unknown field" in res["bad"].errors


def test_field_facet_selection_and_counts(spark):
    df = frame(spark, [event(0, fields='{"region": "eu", "n": 1}'), event(1, fields='{"region": "us"}'),
                       event(2, fields='{"nested": {"region": "eu"}}')])
    st = FI.FilterState(facets={"fields.region": {"include": ["eu"]}})
    assert ids(FI.apply_filter(df, st)) == [0]
    counts = {(r.facet, r.value): r["count"] for r in FA.facet_counts_all(df, st).collect()}
    assert counts[("fields.region", "eu")] == 1 and counts[("fields.region", "us")] == 1  # own selection ignored
    assert counts[("fields.n", "1")] == 1 and ("fields.nested", None) not in counts
    exc = FI.FilterState(facets={"fields.region": {"exclude": ["eu"]}})
    assert ids(FI.apply_filter(df, exc)) == [1, 2]  # lacking the facet passes an exclude


def test_predicates_on_derived_and_numeric_text(spark):
    df = frame(spark, [event(0, message="[Cache] miss", request_id="r-1", fields='{"v": "12.50", "w": 0.1}'),
                       event(1, message="plain", subsystem="net.remote", fields='{"v": "abc", "w": 0.3}')])
    def q(*preds):
        return ids(FI.where_predicates(df, list(preds)))
    assert q(("tag", "=", "cache")) == [0]            # derived tag, ASCII case-insensitive
    assert q(("tag", "=", "Net")) == [1]
    assert q(("correlation", "=", "r-1")) == [0]
    assert q(("schema_version", "=", "1")) == [0, 1]
    assert q(("fields.v", ">", "12")) == [0]          # numeric text compared as a number
    assert q(("fields.v", "!=", "5")) == [0, 1]       # '!=' on a text field: text comparison
    assert q(("fields.v", "<", "100")) == [0]         # number literal: unparsable 'abc' -> false
    assert q(("fields.w", "=", "0.1")) == [0]         # equality within f64 epsilon
    assert q(("Level", "=", "INFO")) == [0, 1]        # field names are case-insensitive


def test_predicate_literals():
    def built(name, op, raw, now=1_000_000):
        p, error = FI.build_predicate(name, op, raw, now)
        return (p.field, p.operator, p.literal) if p else error

    assert built("Timestamp", "<", "last-10S") == ("timestamp", ">=", 990_000.0)
    assert built("timestamp", "=", "1970-01-01T00:00:01.5Z") == ("timestamp", "=", 1500.0)
    assert built("duration_ms", "=", "'12.5'") == ("duration_ms", "=", 12.5)
    assert built("fields.Key", "=", '"a \\"b\\""') == ("fields.Key", "=", 'a "b"')
    for bad in [("nope", "=", "1"), ("fields.", "=", "1"), ("level", "~", "x"), ("level", "=", '"x'), ("level", "=", "''"),
                ("level", ">", "warn"), ("duration_ms", "=", "1.0d"), ("timestamp", "=", "2024-13-01T00:00:00Z"),
                ("timestamp", "=", "last-0s"), ("timestamp", "=", "soon")]:
        assert isinstance(built(*bad), str), bad
    far = built("timestamp", "<", "9" * 400)
    assert far[2] == float(FI._FAR_MS)


def test_time_predicates_compare_whole_milliseconds(spark):
    from datetime import timedelta
    from conftest import BASE
    df = frame(spark, [event(i, timestamp=BASE + timedelta(microseconds=500 * i)) for i in range(6)])
    ms = 1704067200000
    for op, wanted in {"=": [2, 3], "!=": [0, 1, 4, 5], "<": [0, 1], "<=": [0, 1, 2, 3], ">": [4, 5], ">=": [2, 3, 4, 5]}.items():
        assert ids(FI.where_time(df, op, str(ms + 1))) == wanted, op
    assert ids(FI.where_time(df, "<", "9" * 400)) == [0, 1, 2, 3, 4, 5]
    assert ids(FI.where_time(df, "<", "-" + "9" * 400)) == []


def test_included_facet_that_a_row_lacks(spark):
    df = frame(spark, [event(0, provider="p"), event(1), event(2, provider="q")])
    counts = {(r.facet, r.value): r["count"] for r in
              FA.facet_counts_all(df, FI.FilterState(facets={"provider": {"include": ["p"]}})).collect()}
    assert counts[("source", "app")] == 1 and counts[("provider", "q")] == 1
