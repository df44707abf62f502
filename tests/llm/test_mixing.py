import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import mixing as M
from logspark.llm.queries import ORACLE, QUERIES


def filled(sizes, weights, cap=3):
    """Targets by plain rounds: give by weight, cap, share the excess anew."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while left > 1e-9 and open_:
        unit = left / sum(weights[i] for i in open_)
        for i in open_:
            target[i] += unit * weights[i]
        left = sum(max(0, target[i] - cap * sizes[i]) for i in open_)
        for i in list(open_):
            if target[i] >= cap * sizes[i] - 1e-9:
                target[i] = cap * sizes[i]
                open_.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[10], [0, 0], [0, 5, 9], [1, 1, 1, 1000], [5, 300, 2, 70, 4, 4, 900], [7] * 20])
def test_targets_equal_rounds_of_sharing(spark, sizes):
    names = [f"s{i:03d}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.targets(df).collect()}
    want = filled(sizes, [i % 3 + 1 for i in range(len(sizes))])
    assert [got[n] for n in names] == pytest.approx(want)


@pytest.mark.parametrize("knots", M.CURRICULUM + (((0.0, 0.0), (0.3, 4.0), (1.0, 0.5)),))
def test_position_inverts_the_integral(spark, knots):
    rows = spark.range(101).select((F.col("id") / 100).alias("y")).select("y", M._position(F.col("y"), knots).alias("t")).collect()
    for y, t in rows:
        ts = np.linspace(0, t, 20001)
        area = np.trapezoid(np.interp(ts, *zip(*knots)), ts)
        assert area / M.integral(knots) == pytest.approx(y, abs=2e-4)


def test_mix_rows_follow_the_plan(spark):
    rows = [(i, "w " * (i % 40), "a" if i % 3 else None, 1) for i in range(400)] + [(7, "w w", "a", 1)] * 2 + [(None, None, "tiny", 1), (5, "x", "tiny", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan = M.mix_plan(docs).collect()
    assert len(plan) == len(rows) and [tuple(r) for r in plan] == [tuple(r) for r in M.mix_plan(docs.repartition(5)).collect()]
    by = {}
    for r in plan:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 40
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert M.mix(docs.limit(0)).count() == M.mix_plan(docs.limit(0)).count() == 0


def test_very_long_text_and_clashing_names(spark):
    rows = [(1, "w " * 500_000, "a", 1, "x"), (2, "w w", "a", 2, "y"), (3, "w", "b", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, __id string")
    plan = {r["id"]: r["copies"] for r in M.mix_plan(docs).collect()}
    assert sorted(map(tuple, M.mix(docs).collect())) == sorted(r for r in rows for _ in range(plan[r[0]]))


def test_query_equals_its_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    q = QUERIES["op8_source_mixing"](spark, sf)
    names = q.columns
    key = lambda r: r[0]
    got = sorted((tuple(r) for r in q.collect()), key=key)
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE['op8_source_mixing']})").fetchall(), key=key)
    assert got == want
