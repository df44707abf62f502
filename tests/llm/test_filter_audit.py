from itertools import permutations
from math import factorial

import duckdb
import pytest
from pyspark.sql import functions as F

from logspark.llm import filter_audit as A
from logspark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("names", ["A", "AB", "ABCD", "ABCDE"])
def test_paths_through_every_edge(names):
    edges, k = A.lattice(names), len(names)
    assert len(edges) == k * 2 ** (k - 1)
    for e in edges:
        before = e.state.bit_count()
        assert e.paths == len(e.orders) == factorial(before) * factorial(k - before - 1)
    assert sum(e.paths for e in edges) == k * factorial(k)
    assert A.lattice("AB")[0] == A.Edge(0, 1, ("AB",), 1)
    with pytest.raises(ValueError):
        A.lattice("ABCDEFG")


def brute(rows, marks, names, fails):
    """The audit document by document: rows (id, text, part), fails[name](text); E by comparison with all rows."""
    good = {i for i, g, _ in marks if g and i is not None}
    toxic = {i for i, _, t in marks if t and i is not None}
    failed = [{n for n in names if (fails[n](t or "") if n in fails else
                                    i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows))} for i, t, _ in rows]
    out, total = {}, {}
    parts = {p or "" for _, _, p in rows}
    for order in permutations(names):
        alive = list(range(len(rows)))
        for step, f in enumerate(order, 1):
            lost = [d for d in alive if f in failed[d]]
            alive = [d for d in alive if f not in failed[d]]
            for p in parts:
                own = [d for d in range(len(rows)) if (rows[d][2] or "") == p]
                gone = [d for d in lost if d in own]
                total[p, f] = total.get((p, f), 0) + len(gone)
                out[p, "".join(order), step] = (
                    len([d for d in alive if d in own]), len(gone), sum(f in failed[d] for d in own if d not in alive and d not in lost),
                    sum(failed[d] == {f} for d in own), sum(rows[d][0] in good for d in gone), sum(rows[d][0] in toxic for d in gone))
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_rows_equals_brute_force(spark):
    texts = [None, "", "a b c", "a a a a a", "HELLO WORLD", "x # y", "a b c", "HELLO # A A A", "word " * 120, " ".join(f"w{i}" for i in range(150))]
    rows = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts * 3)]
    rows += [(3, "a b c", "en"), (3, "a b c", "en"), (3, "a b c", "de"), (None, "a b c", "en"), (None, "a b c", "en"), (-5, "x # y", None)]
    marks = [(0, True, None), (0, None, True), (3, True, True), (7, False, False), (None, True, True), (16, True, False), (99, True, True)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, lang string, mask int, good boolean")
    counts = A.failure_counts(docs, A.quality_filters(A.text_of()), "E", spark.createDataFrame(marks, "id long, good boolean, toxic boolean"))
    got = A.audit(counts, "ABCDE").collect()
    fails = {"A": lambda t: len(t.split()) < 100, "B": lambda t: 100 * len(set(t.split())) < 80 * len(t.split()),
             "C": lambda t: 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": lambda t: any(c in "#$%&*|" for c in t)}
    assert len(got) == 3 * 600 and {tuple(r) for r in got} == brute(rows, marks, "ABCDE", fails)
    few = A.audit(A.failure_counts(docs, {"D": A.quality_filters(A.text_of())["D"]}), "D").collect()
    assert {(r["part"], r["removed"], r["shapley"]) for r in few} == {(p, n, n) for p, n in
            ((p, sum(1 for _, t, q in rows if (q or "") == p and "#" in (t or ""))) for p in ("", "de", "en"))}


def test_very_long_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "Word " * 1_000_000, "en"), (2, "z" * 5_000_000, "en")], "doc_id long, text string, lang string")
    counts = A.failure_counts(docs, A.quality_filters(A.text_of()), "E")
    assert sorted(tuple(r) for r in counts.collect()) == [("en", 1, 1, 0, 0), ("en", 6, 1, 0, 0)]
    assert A.audit(A.failure_counts(docs.limit(0), A.quality_filters(A.text_of()), "E"), "ABCDE").count() == 0


def test_copies_are_summed_before_they_meet(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    counts = A.failure_counts(docs, {"A": F.lit(False)}, "E").collect()
    assert sorted((r["mask"], r["n"]) for r in counts) == [(0, 1), (2, 5999)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_oracle(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    q = QUERIES["op12_filter_audit"](spark, sf)
    got = sorted(tuple(r) for r in q.collect())
    want = sorted(con.execute(f"SELECT {', '.join(q.columns)} FROM ({ORACLE['op12_filter_audit']})").fetchall())
    assert got == want and len(got) % 600 == 0 and len(got) > 0
