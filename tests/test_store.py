import tempfile

from logspark.operators import facets as FA
from logspark.operators import filters as FI
from logspark.sources import store as SS
from logspark.sources import tables as T

SMOKE = "/root/testdata/sf0.001"


def test_store_round_trip_prunes_and_matches(spark):
    path = tempfile.mkdtemp(prefix="logspark-store-") + "/store"
    ev = T.load_events(spark, SMOKE)
    SS.write_event_store(ev, path)
    st = SS.read_event_store(spark, path)
    assert set(SS.DERIVED) <= set(st.columns)
    state = FI.FilterState(facets={"source": {"include": ["src0"]}, "tag": {"include": ["Error"]}},
                           minimum_level="warn", text="value")
    a = sorted(r.event_id for r in FI.apply_filter(ev, state).select("event_id").collect())
    b = sorted(r.event_id for r in FI.apply_filter(st, state).select("event_id").collect())
    assert a == b and a
    plan = FI.apply_filter(st, state)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "source" in plan
    ca = sorted(tuple(r) for r in FA.facet_counts_all(ev, state, ordered=False).collect())
    cb = sorted(tuple(r) for r in FA.facet_counts_all(st.drop("event_date"), state, ordered=False).collect())
    assert ca == cb


def test_store_filters_reach_the_scan(spark):
    path = tempfile.mkdtemp(prefix="logspark-store-") + "/store"
    ev = T.load_events(spark, SMOKE)
    SS.write_event_store(ev, path)
    st = SS.read_event_store(spark, path)
    now = 1704326400000
    cases = {  # filter -> what the scan must show
        "correlation": (FI.FilterState(correlation="req-1"), ["EqualTo(correlation,req-1)"]),
        "duration": (FI.FilterState(predicates=[("duration_ms", ">", "100")]), ["GreaterThan(duration_ms,100.0)"]),
        "level": (FI.FilterState(predicates=[("level", "=", "ERROR")]), ["EqualTo(level,error)"]),
        "time": (FI.FilterState(predicates=[("timestamp", ">", "last-2d"), ("timestamp", "<", "2024-01-03T12:00:00Z")], now_ms=now),
                 ["GreaterThanOrEqual(timestamp,", "LessThan(timestamp,", "event_date"]),
    }
    for name, (state, wanted) in cases.items():
        got = FI.apply_filter(st, state).select("event_id")
        plan = got._jdf.queryExecution().executedPlan().toString()
        scan = [line for line in plan.splitlines() if "FileScan" in line]
        assert scan and all(w in scan[0] for w in wanted), (name, scan)
        if name == "time":
            assert "event_date" in scan[0].split("PartitionFilters: [")[1].split("]")[0]
        a = sorted(r.event_id for r in got.collect())
        assert a == sorted(r.event_id for r in FI.apply_filter(ev, state).select("event_id").collect()), name


def test_stored_fingerprint_locates_pins(spark):
    from logspark.operators import pins as PN
    from pyspark.sql import functions as F

    path = tempfile.mkdtemp(prefix="logspark-store-") + "/store"
    ev = T.load_events(spark, SMOKE)
    SS.write_event_store(ev, path)
    pins = PN.take_pins(ev.where("event_id % 97 = 0"), F.lit("n"))
    rows = [sorted(tuple(r) for r in PN.locate_pins(pins, e).select("pin_key", "matched_event_id", "retained").collect())
            for e in (ev, SS.read_event_store(spark, path))]
    assert rows[0] == rows[1] and all(r[2] for r in rows[0])


def _rows_scanned(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_point_look_ups_skip_row_groups(spark):
    from pyspark.sql import functions as F

    path = tempfile.mkdtemp(prefix="logspark-store-") + "/store"
    SS.write_event_store(T.load_events(spark, SMOKE), path)
    st = SS.read_event_store(spark, path)
    assert st.agg(F.min("correlation"), F.max("correlation")).first()[0] < "req-0000" < st.agg(F.max("correlation")).first()[0]
    assert _rows_scanned(FI.where_correlation(st, "req-0000").select("event_id")) == 0  # in the range of values, but nowhere
    assert _rows_scanned(st.where(F.col("fingerprint") == "7" * 16).select("event_id")) == 0
    found = FI.where_correlation(st, "req-1").select("event_id")
    assert 0 < len(found.collect()) <= _rows_scanned(found) < st.count()
