import hashlib
import random

import numpy as np

from logspark.llm import fingerprints as P
from logspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_fingerprint_over_blocks_and_case(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(3000))
    whole = P.fingerprint(text)
    assert (whole == P.fingerprint(text.lower())).all() and (P.fingerprint(" \n") == 0).all()
    real = P.word_blocks
    monkeypatch.setattr(P, "word_blocks", lambda data: real(data, 50))
    assert (P.fingerprint(text) == whole).all()
    assert P.likeness(whole, whole) == 1.0 and 0 <= P.likeness(whole, ~whole) <= 1


def test_query_follows_the_next_document(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in QUERIES["op1_document_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    prints = {}
    for k, (i, text) in enumerate(docs):
        text, following = text or "", docs[(k + 1) % len(docs)][1] or ""
        cut = len(text) // 4
        changed = text[:len(text) - cut] + following[:cut]
        r = got[i]
        a, b, c = (P.fingerprint(t) for t in (text, changed, following))
        prints[i] = int(a[0]) << 64 | int(a[1])
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{prints[i]:032x}", f"{int(b[0]):016x}{int(b[1]):016x}")
        assert (r["near_edited"], r["near_next"]) == (P.likeness(a, b), P.likeness(a, c))
    for i, r in got.items():
        want = sum((prints[i] ^ p).bit_count() <= P.RADIUS for p in prints.values()) - 1
        assert r["n_near"] == (want if i % 50 == 0 else None)
    far = [r["near_edited"] > r["near_next"] for r in got.values() if r["n_chars"] > 200]
    assert np.mean(far) > 0.99


def test_ranges_are_joined_up(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_RANGE", 3)
    rng = random.Random(2)
    for ids in (range(40), [rng.randrange(-10**18, 10**18) for _ in range(40)], [-2**63, 2**63 - 1, 0, 5], [1, 2, 3, 10**6], [7]):
        docs = [(i, f"text of {i} and more words") for i in ids]
        got = {r["id"]: r["edited_sha256"] for r in P.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        docs.sort()
        for k, (i, text) in enumerate(docs):
            assert got[i] == hashlib.sha256(P.edited(text, docs[(k + 1) % len(docs)][1]).encode()).hexdigest()


def test_nulls_repeats_long_texts_and_empty_table(spark):
    rows = [(None, "null id text", 1), (1, None, 1), (1, "b b b b", 1), (1, "b b b b", 1), (2, "x " * 200000, 1), (3, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, range int")
    got = P.searched(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 7, 7, 12, 400000]
    order = ["null id text", "", "b b b b", "b b b b", "x " * 200000, ""]
    want = sorted(hashlib.sha256(P.edited(t, order[(k + 1) % 6]).encode()).hexdigest() for k, t in enumerate(order))
    assert sorted(r["edited_sha256"] for r in got) == want
    assert P.searched(df.limit(0)).count() == 0


def test_tables_find_all_within_the_radius(spark):
    rng = random.Random(9)
    prints = {0, 2**128 - 1}
    for _ in range(10):
        x = rng.getrandbits(128)
        for _ in range(15):
            y = x
            for b in rng.sample(range(128), rng.randrange(9)):
                y ^= 1 << b
            prints.add(y)
    signed = lambda v: v - 2**64 if v >> 63 else v
    df = spark.createDataFrame([(signed(p >> 64), signed(p & (2**64 - 1))) for p in prints], "hi long, lo long")
    whole = lambda hi, lo: (hi % 2**64) << 64 | (lo % 2**64)
    got = [(whole(*r[:2]), whole(*r[2:])) for r in P.within_radius(df, df).collect()]
    want = {(a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 6}
    assert set(got) == want and len(got) == len(want)


def test_neither_side_of_the_search_is_broadcast(spark):
    nodes = lambda df: df._jdf.queryExecution().executedPlan().toString()
    prints = spark.createDataFrame([(i, -i) for i in range(200)], "hi long, lo long")
    for queries, among in ((prints.limit(3), prints), (prints, prints.limit(3))):
        found = P.within_radius(queries, among)
        rows = {tuple(r) for r in found.collect()}
        assert {(i, -i, i, -i) for i in range(3)} <= rows and "Broadcast" not in nodes(found) and "SortMergeJoin" in nodes(found)
