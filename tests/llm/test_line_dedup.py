import random

import numpy as np

from logspark.llm import line_dedup as L
from logspark.llm.queries import QUERIES


def brute(docs, similarity=0.8):
    """{(id, line): kept id} of the lines that go, by all pairs."""
    at, sets = [], []
    for i, text in sorted(docs):
        for n, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\r"):
                at.append((i, n))
                sets.append(L.shingles(line))
    root = list(range(len(at)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for y in range(len(at)):
        for x in range(y):
            if sets[x] == sets[y] or L.jaccard(sets[x], sets[y]) >= similarity:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {at[x]: at[find(x)][0] for x in range(len(at)) if find(x) != x}


def test_minhash_in_pieces_equals_whole(monkeypatch):
    rng = random.Random(3)
    lines = ["", "ab", "abcdefg", "𐍈" * 9] + ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 400))) for _ in range(50)]
    whole = L.minhash(lines)
    monkeypatch.setattr(L, "_BATCH_CHARS", 40)
    assert np.array_equal(whole, L.minhash(lines)) and whole.shape == (54, L.BANDS * L.ROWS)
    assert L.minhash([]).shape == (0, L.BANDS * L.ROWS)


def test_band_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    hit = total = 0
    for _ in range(300):
        a = rng.choice(letters, 300)
        b = a.copy()
        b[rng.choice(300, 4, replace=False)] = "#"
        a, b = "".join(a), "".join(b)
        if L.jaccard(L.shingles(a), L.shingles(b)) >= 0.8:
            keys = L.band_keys(L.minhash([a, b]), L.BANDS, L.ROWS)
            hit, total = hit + bool((keys[0] == keys[1]).any()), total + 1
    assert total > 100 and hit / total > 0.95


def test_shingle_sets_compare_like_sets_of_texts(monkeypatch):
    rng = random.Random(7)
    for letters in ("ab", "abcdefgh \x00\x7f", "aé𐍈\x00 ", [chr(c) for c in range(0x4E00, 0x4E00 + 700)]):
        for few in (0, 3):
            monkeypatch.setattr(L, "_FEW", few)
            for _ in range(40):
                lines = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 6, 7, 8, 60, 300]))) for _ in range(rng.choice([2, 3]))]
                lines += [lines[0][:-1] + rng.choice(letters), lines[0] + lines[0][:3] + "\x00"]
                texts, sets = [L.shingles(x) for x in lines], L.ShingleSets(lines, L.SHINGLE)
                for i in range(len(lines)):
                    assert len(sets[i]) == len(texts[i])
                    for j in range(i):
                        for s in (0.8, L.jaccard(texts[i], texts[j])):
                            assert sets.alike(i, j, s) == (L.jaccard(texts[i], texts[j]) >= s)
    assert L.ShingleSets(["a" * 300, "a" * 300 + "b"], 40).alike(0, 1, 0.5) and isinstance(L.ShingleSets(["é", "x"], 40)[0], set)


def test_lines_are_numbered_like_split():
    for text in ("", "\n", "a", " a\t\r\n\n \t\nb \n", "\na\u2028b\x0bc\x85\n"):
        assert list(L._numbered(text)) == [(n, s.strip(" \t\r")) for n, s in enumerate(text.split("\n")) if s.strip(" \t\r")]


def test_only_keys_with_a_partner_are_dealt_and_lines_stay_in_python(spark, monkeypatch):
    """Neither the bucket join nor the line steps send what has no partner through a shuffle or an interpreted loop."""
    picked = []
    monkeypatch.setattr(L.KeyFilter, "only_held", lambda self, keys, f=L.KeyFilter.only_held: picked.append(1) or f(self, keys))
    docs = spark.createDataFrame([(i, f"line number {i} is like no other {i * 7919}\nthe same line in every document") for i in range(20)], "doc_id long, text string")
    found = L.duplicate_lines(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert picked and "transform(" not in plan and found.count() == 19


def test_rows_that_repeat_lose_a_line_once(spark):
    rows = [(1, "a line that both documents have\n1"), (2, "a line that both documents have\n2"), (2, "a line that both documents have\n2"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"] or 0, r["n_lines"], r["dropped"], r["kept_ids"]) for r in L.line_report(docs).collect())
    assert got == [(0, 1, [], []), (1, 2, [], []), (2, 2, [0], [1]), (2, 2, [0], [1])]
    assert [tuple(r)[0::2] for r in L.duplicate_lines(docs).collect()] == [(2, 0)]


def _report(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = L.line_report(df, **kw).collect()
    return {(r["id"], n): None for r in rows for n in r["dropped"]}, rows


def test_groups_with_tiny_tiles_equal_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(160)) for _ in range(6)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(4):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 2])):
                line[rng.randrange(len(line))] = "#"
            lines.append("".join(line) if rng.random() < 0.8 else f"only here {i} {rng.random()}")
        docs.append((i, "\n".join(lines + ["", "  "])))
    want = brute(docs)
    for tile in (512, 3):
        got, _ = _report(spark, docs, tile=tile)
        assert set(got) == set(want)


def test_cleaned_texts_nulls_repeats_and_columns(spark):
    line = "a line of text that is long enough to be compared with others"
    rows = [(3, f"{line}\nown words of three", "x"), (1, f" {line}\t\r\n\nunique to one", "x"), (2, line, "x"), (4, None, "x"), (5, "", "x"),
            (6, "same rows repeat, both stay", "x"), (6, "same rows repeat, both stay", "x"), (None, f"null id\n{line}", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in L.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(3, "own words of three"), (1, "\nunique to one"), (4, None), (5, ""), (6, rows[5][1]), (6, rows[5][1]),
                          (0, f"null id\n{line}")], key=str)
    assert L.dedup_lines(docs).columns == docs.columns
    assert L.dedup_lines(docs.limit(0)).count() == L.line_report(docs.limit(0)).count() == 0


def test_documents_left_with_blank_lines_only_go(spark):
    lines = [f"line {c * 9} that is long enough to be compared" for c in "abc"]
    rows = [(1, "\n\n".join(lines)), (2, "\n\n".join(lines)), (3, "\n \t\n".join(lines) + "\r\n"), (4, f"{lines[0]}\n\nown words of four"), (5, "\n\n")]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 4: "\nown words of four", 5: "\n\n"}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, got = brute(docs), QUERIES["op10_line_dedup"](spark, sf).collect()
    assert len(got) == len(docs)
    assert {(r["doc_id"], n) for r in got for n in r["dropped"]} == set(want)
    for r in got:
        assert set(r["kept_ids"]) == {want[r["doc_id"], n] for n in r["dropped"]}
