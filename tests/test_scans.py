import random

from logspark.operators import navigation as NV
from logspark.operators import scans as SC
from tests.conftest import event, frame


def test_running_sums_over_many_ranges_equal_plain_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, m long, n long")
    for within in ([], ["g"]):
        got = {(r.g, r.m): r.before for r in SC.running_sums(df, within, ["m"], "n", "before").collect()}
        sums = {}
        for g, m, n in sorted(rows, key=lambda r: r[1]):
            key = g if within else 0
            assert got[g, m] == sums.get(key, 0)
            sums[key] = sums.get(key, 0) + n
    assert SC.running_sums(df.limit(0), [], ["m"], "n", "before").count() == 0


def _brute(levels, groups):
    out = {}
    for i, g in enumerate(groups):
        errors = [j for j in range(len(levels)) if levels[j] == "error" and groups[j] == g]
        out[i] = (next((j for j in errors if j > i), errors[0] if errors else None),
                  next((j for j in reversed(errors) if j < i), errors[-1] if errors else None))
    return out


def test_error_neighbours_of_the_whole_view_and_of_runs(spark):
    rng = random.Random(5)
    for share in (0.0, 0.01, 0.3):
        levels = ["error" if rng.random() < share else "info" for _ in range(800)]
        runs = [rng.choice("xyz") for _ in levels]
        df = frame(spark, [event(i, level=a, app_session_id=g) for i, (a, g) in enumerate(zip(levels, runs))])
        for parts, groups in (((), [0] * 800), (("app_session_id",), runs)):
            got = NV.error_neighbours(df, partition_cols=parts, block_size=7)
            assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
            assert {r.event_id: (r.next_error_id, r.previous_error_id) for r in got.collect()} == _brute(levels, groups)
