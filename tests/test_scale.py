import os
import tempfile

from logspark.plans import catalog
from logspark.sources import store as SS
from logspark.sources import tables as T
from pyspark.sql import functions as F


def _events(spark, n=400):
    """A table of events in one file, as few splits as a narrow, well compressed table takes."""
    base = tempfile.mkdtemp(prefix="logspark-scale-")
    kind = F.element_at(F.array(*map(F.lit, ("error", "view", "signup", "purchase", "click"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(T.BASE_EPOCH_SECONDS) + F.col("id") * 700).cast("timestamp_ntz").alias("ts"))
    rows = rows.withColumns({"user_id": F.col("event_id") * 7 % 11, "event_type": kind, "value": F.col("event_id") / 4,
                             "props": F.concat(F.lit('{"k": '), (F.col("event_id") % 100).cast("string"), F.lit("}"))})
    rows.coalesce(1).write.parquet(f"{base}/events.parquet")
    return base


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heavy_work_on_events_is_dealt_over_tasks(spark):
    base = _events(spark)
    for name in ("number_texts", "repeated_keys"):
        plan = _plan(catalog.QUERIES[name](spark, base))
        assert "REPARTITION_BY_COL" in plan, name


def test_landing_files_of_streams_are_written_by_all_tasks(spark, monkeypatch):
    base, seen = _events(spark), []
    load = T.load_spread_events
    monkeypatch.setattr(T, "load_spread_events", lambda *a: seen.append(_plan(load(*a))) or load(*a))
    path = catalog._landing_events(spark, base)
    assert seen and "REPARTITION_BY_COL" in seen[0] and spark.read.parquet(path).count() == 400
    assert len([f for f in os.listdir(catalog._landing_events(spark, base, files=4)) if f.startswith("part-")]) == 4


def test_store_derives_columns_once_behind_the_range_shuffle(spark, monkeypatch):
    base, plans = _events(spark), []
    enrich = SS.enrich
    monkeypatch.setattr(SS, "enrich", lambda df: plans.append(_plan(df)) or enrich(df))
    path = os.path.join(tempfile.mkdtemp(prefix="logspark-scale-"), "store")
    SS.write_event_store(T.load_spread_events(spark, base), path)
    assert "rangepartitioning" in plans[0] and "sha2" not in plans[0]
    cols = [*SS.DERIVED, "event_id", "event_date"]
    same = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert same(SS.read_event_store(spark, path)) == same(enrich(T.load_events(spark, base)))
