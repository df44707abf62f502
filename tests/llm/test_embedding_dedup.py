import numpy as np

from logspark.llm import embedding_dedup as D
from logspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (label, np.array(v, np.float32).astype(float))
    links = {i: [] for i, _, _ in rows}
    for i, (li, a) in ok.items():
        for j, (lj, b) in ok.items():
            if i != j and li == lj and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                links[i].append(j)
    out = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += links[x]
    return {i: (len(links[i]), out[i], out[i] == i) for i in links}


def check(spark, rows, **kw):
    got = D.near_duplicates(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len(rows)


def test_clusters_in_small_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append((len(rows) * 3 % 1009, [float(x) for x in centre * rng.uniform(0.1, 9) + rng.normal(size=16) * rng.choice([0, 0.05, 0.1, 0.2, 1])], c % 2))
    for tile in (1024, 7):
        check(spark, rows, tile=tile)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 1), (9, [5.0, 0.0], 1), (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1.0, 0.0], 2), (14, [1e-30, 0.0], 1)]
    check(spark, rows)
    assert D.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_without_an_id_join_nothing_by_it(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1, 0), (None, [1.0, 0.01, 0.0], 1, 0), (2, [0.0, 1.0, 0.0], 1, 0), (None, [0.0, 1.0, 0.01], 1, 0),
            (None, [0.0, 0.0, 1.0], 1, 0), (None, None, 1, 0), (7, [0.0, 0.0, 1.0], 2, 0), (7, [0.0, 1.0, 0.0], 2, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node int")
    got = sorted(map(tuple, D.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (None, 1, 1, False), (2, 1, 2, True), (None, 1, 2, False), (None, 0, None, False), (None, 0, None, False),
                          (7, 0, 7, True), (7, 0, 7, True)], key=str)


def test_very_long_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 3000))
    check(spark, [(i, [float(x) for x in base[i % 6] + rng.normal(size=3000) * 0.05], 1) for i in range(18)])


def test_pairs_equal_plain_products():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(300, 40)) @ np.diag(np.linspace(3, 0.05, 40))
    b = a[rng.permutation(300)] + rng.normal(size=(300, 40)) * 0.1
    for t in (0.9, 0.98):
        want = set(zip(*np.nonzero(D.unit(a) @ D.unit(b).T >= t)))
        for axes in (None, D.principal_axes(a), D.principal_axes(a)[:, :10]):
            got = [p for i, j in D.close_pairs(a, b, axes, t) for p in zip(i.tolist(), j.tolist())]
            assert set(got) == want and len(got) == len(want)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op6_embedding_near_dedup"](spark, sf).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(rows)
