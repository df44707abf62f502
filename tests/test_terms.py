import os
import random
import tempfile

from logspark.operators import filters as FI
from logspark.operators import terms as TM
from logspark.sources import store as SS
from logspark.sources import tables as T
from tests.conftest import event, frame


def _indexed(spark, events):
    base = tempfile.mkdtemp(prefix="logspark-terms-")
    SS.write_event_store(events, os.path.join(base, "store"))
    store = SS.read_event_store(spark, os.path.join(base, "store"))
    TM.write_term_index(store, os.path.join(base, "index"))
    return store, os.path.join(base, "index")


TEXTS = ["", " ,. ", "connection", "conection", "conn", "nnect", "timeout refused", "timeuot", "Éclair", "eclair zür", "ab", "x" * 70, "u1 u2", "connection timeout", "2024"]


def test_index_finds_what_the_scan_finds(spark):
    rng = random.Random(6)
    words = ["connection", "Connections", "conected", "timeout", "timeouts", "refused", "éclair", "zürich", "ab", "abc", "x" * 71, "y" * 64, "user_name", "a-b"]
    rows = [event(i, message=" ".join(rng.choices(words, k=rng.randrange(5))), source=rng.choice("pq"), fields=f'{{"user": "u{i % 4}"}}') for i in range(150)]
    df = frame(spark, rows)
    store, index = _indexed(spark, df)
    for text in TEXTS:
        for fuzzy in (True, False):
            want = sorted(r.event_id for r in FI.search(df, text, fuzzy).select("event_id").collect())
            assert sorted(r.event_id for r in TM.search_indexed(store, index, text, fuzzy).select("event_id").collect()) == want, (text, fuzzy)
    want = sorted(r.event_id for r in FI.search_since(df, "timeout", 100).select("event_id").collect())
    assert sorted(r.event_id for r in TM.search_indexed(store, index, "timeout", after_event_id=100).select("event_id").collect()) == want and want


def test_document_texts_are_not_read(spark):
    docs = T.load_documents(spark, "/root/testdata/sf0.001")
    store, index = _indexed(spark, docs)
    got = TM.search_indexed(store, index, "Thanedbel, tion").select("event_id")
    scans = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert scans and not any("search_document" in s or "message" in s for s in scans)
    want = sorted(r.event_id for r in FI.search(docs, "Thanedbel, tion").select("event_id").collect())
    assert sorted(r.event_id for r in got.collect()) == want and len(want) > 5
    assert TM.matching_words(spark.read.parquet(f"{index}/words"), ["thanedbel"]).count() >= 1
