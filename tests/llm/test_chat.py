import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from logspark.llm import chat as C
from logspark.llm.queries import ORACLE, QUERIES

ODD = ["", "<|", "<\\|", "<\\\\|x<|im_end|>\n", C.START + "assistant\nhi" + C.END, "a<|b\\|<", "line\nline\n", "é𐍈<|é"]


def test_layouts_have_different_fingerprints():
    assert len(C.BY_HASH) == len(C.LAYOUTS)


def test_odd_texts_survive_and_mask_covers_assistants(spark):
    rows = [(i, t, r, x) for i in range(3) for t, (r, x) in enumerate((r, x) for x in ODD for r in ("user", "assistant", "tool x\n<|"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = C.format_turns(C.canonical_turns(df))
    got = done.select("*", C.read_turns(F.col("formatted")).alias("t"), C.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    assert len(got) == 3
    for g in got:
        own = [(r, x) for i, _, r, x in rows if i == g["id"]]
        assert [tuple(t) for t in g["t"]] == own
        assert g["l"] == "".join(x for r, x in own if r == "assistant")
        assert g["formatted"].count(C.START) == len(own) and g["formatted"].count("<|im_end|>") == len(own)
        assert sum(s["skip"] + s["take"] for s in g["loss"]) <= len(g["formatted"])


def test_tables_of_every_layout_give_the_same_turns(spark):
    want = [("user", "q"), ("assistant", "a")]
    tables = [
        ("conv_id long, turn int, role string, text string, prompt_id int", [(1, 1, "assistant", "a", 0), (1, 0, "user", "q", 0)]),
        ("conv_id long, messages array<struct<role:string,content:string,extra:int>>", [(1, [("user", "q", 1), ("assistant", "a", 2)])]),
        ("conv_id long, conversations array<struct<`from`:string,value:string>>", [(1, [("human", "q"), ("gpt", "a")])]),
        ("conv_id long, prompt string, completion string", [(1, "q", "a")]),
        ("conv_id long, prompt string, chosen string, rejected string", [(1, "q", "a", "z")]),
        ("conv_id long, instruction string, input string, output string", [(1, "q", "", "a")]),
        ("conv_id long, instruction string, output string", [(1, "q", "a")]),
    ]
    for schema, rows in tables:
        got = C.canonical_turns(spark.createDataFrame(rows, schema)).collect()
        assert [(r["id"], [tuple(t) for t in r["turns"]]) for r in got] == [(1, want)]
    with pytest.raises(ValueError):
        C.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


def test_records_of_mixed_layouts(spark):
    records = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
               {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "meta": {"x": 1}},
               {"prompt": "q", "completion": "a"}, {"instruction": "q", "input": "more", "output": "a"}, {"other": 1}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "{broken"), (10, None)], "id long, line string")
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in C.record_turns(df, "id", "line").collect()}
    want = [("user", "q"), ("assistant", "a")]
    assert got == {0: ("messages", want), 1: ("exchanges", want), 2: ("prompt", want), 3: ("instruction", [("user", "q\nmore"), ("assistant", "a")]),
                   4: (None, []), 9: (None, []), 10: (None, [])}


def test_records_with_nulls_late_fields_and_two_layouts(spark):
    records = [{"messages": [{"role": "assistant", "content": None}, {"role": "user", "content": "q"}]},
               {"messages": [{"role": "tool"}, {"role": "user", "content": "q"}], "prompt": "p"},
               {"prompt": "q", "completion": "a", "chosen": "c"}, {"prompt": None, "completion": "a"},
               {"instruction": "q", "input": None, "output": "a"}, {"messages": ["x"]}]
    lines = [json.dumps(r) for r in records] + ["[1]", "{broken"]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]], r["problem"]) for r in C.record_turns(df, "id", "line").collect()}
    assert got == {0: ("messages", [("assistant", ""), ("user", "q")], None), 1: ("messages", [("tool", ""), ("user", "q")], None),
                   2: ("prompt", [("user", "q"), ("assistant", "a")], None), 3: ("prompt", [("user", ""), ("assistant", "a")], None),
                   4: ("instruction", [("user", "q"), ("assistant", "a")], None), 5: (None, [], "no known layout"),
                   6: (None, [], "no JSON object"), 7: (None, [], "no JSON object")}


def test_nulls_ties_and_empty_table(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["id"]: [tuple(t) for t in r["turns"]] for r in C.canonical_turns(df).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "x")]}
    done = C.format_turns(C.canonical_turns(df)).select("id", C.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r["id"]: [tuple(t) for t in r["t"]] for r in done} == got
    assert C.format_turns(C.canonical_turns(df.limit(0))).count() == 0


def test_layouts_and_back(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        roles = ["user", "assistant"] if i % 2 else [rng.choice(["user", "assistant", "system", "human", ""]) for _ in range(rng.randrange(1, 5))]
        rows += [(i, t, r, rng.choice(ODD)) for t, r in enumerate(roles)]
    turns = C.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {r["id"]: [tuple(t) for t in r["turns"]] for r in turns.collect()}
    tables, got = C.in_layouts(turns), {}
    for table, name in zip(tables, ("messages", "exchanges", "prompt")):
        assert C.layout_of(table.schema).name == name
        own = {r["id"]: [tuple(t) for t in r["turns"]] for r in C.canonical_turns(table).collect()}
        assert len(own) > 5 and not set(own) & set(got)
        got |= own
    assert got == want


def test_every_set_of_paths_has_its_layout():
    assert len(C.SIGNATURES) == len({h for h in C.SIGNATURES}) > 500
    assert C.SIGNATURES[C.path_hash(["prompt", "completion", "chosen"])] == "prompt"
    assert C.path_hash(["prompt"]) not in C.SIGNATURES


def test_roles_of_turn_rows_stay_as_they_are(spark):
    rows = [(1, i, r, "x") for i, r in enumerate(["human", "bot", "gpt", "model", "assistant"])]
    done = C.format_turns(C.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = done.select(C.read_turns(F.col("formatted")).alias("t"), C.read_loss(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert [t["role"] for t in got["t"]] == [r[2] for r in rows] and got["l"] == "x"
    line = json.dumps({"messages": [{"role": "bot", "content": "a"}]})
    assert C.record_turns(spark.createDataFrame([(1, line)], "id long, line string"), "id", "line").first()["turns"][0]["role"] == "bot"


def test_query_equals_its_oracle(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    q = QUERIES["op5_chat_formatting"](spark, sf)
    want = con.execute(f"SELECT {', '.join(q.columns)} FROM ({ORACLE['op5_chat_formatting']})").fetchall()
    assert sorted(map(tuple, q.collect())) == sorted(want)
