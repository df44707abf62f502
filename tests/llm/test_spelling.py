import random
import re
import zlib
from collections import Counter

import numpy as np

from logspark.llm import spelling as S
from logspark.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(counts):
    out, form = [], {}
    near = {w: [v for v in counts if one_edit(v, w)] for w in counts}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_single_edits_against_all_pairs():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(7, 11))) for _ in range(400)})
    prefix, near = S.single_edits(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert near[i, j] == one_edit(a, b)
            if i != j:
                assert prefix[i, j] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert one_edit("aaaaaaa", "aaaaaaaa") and S.single_edits(["aaaaaaa", "aaaaaaaa"])[1].tolist() == [[False, True], [True, False]]


def test_dense_words_in_tiny_tiles_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 13))): rng.choice([2, 2, 3, 25, 300, 4000]) for _ in range(900)}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    want = {w: (sum(one_edit(v, w) for v in words), min(((-words[v], v) for v in words if one_edit(v, w)), default=None)) for w in words}
    for tile in (1024, 20):
        got = {r["word"]: (r["n_near"], (-r["best_n"], r["best"])) for r in S.near_words(df, tile).collect()}
        assert got == {w: x for w, x in want.items() if x[0]}


def test_odd_rows_equal_brute_force(spark):
    rng = random.Random(8)
    stems = ["reference", "éclairage", "ÀÉÎßting", "straße×ende", "colouring", "Zusammenfassung"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(stems)
            if rng.random() < 0.05:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", "é" + w[at]]) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, " ".join(words) + " 7 colour-ing\nthe_reference"))
    rows += [(None, "reference reference"), (None, None), (4, None), (5, ""), (5, "colouring"), (5, "colouring"), (9, "a" * 40_000 + " " + "a" * 40_000 + " " + "a" * 40_001 + "\n" + "a" * 40_001)]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    got = _got(S.variants(docs))
    assert got == brute(brute_counts(rows))
    assert any(r[1] for r in got) and any(len(r[0]) >= 40_000 for r in got)
    assert S.variants(docs.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(18)] + [("other", "w05")]
    got = dict(S.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w18" for w, _ in chain}
    assert S.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_counts_handed_on_in_parts(spark, monkeypatch):
    rows = [(i, f"working{chr(97 + i % 26)} workings") for i in range(500)]
    assert dict(S.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_counts(rows)
    monkeypatch.setattr(S, "_HELD", 3)
    batch = spark.createDataFrame(rows, "id long, text string").toArrow().to_batches()
    total = Counter()
    for part in S._counted(31, 7)(iter(batch)):
        total.update(dict(zip(part.column("word").to_pylist(), part.column("n").to_pylist())))
    assert {w: n for w, n in total.items() if n >= 2} == brute_counts(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = brute_counts(rows)
    got = _got(QUERIES["op13_spelling_variants"](spark, sf))
    assert {r[0]: r[3] for r in got} == counts
    words = sorted(counts)
    near = S.single_edits(words)[1]
    n = np.array([counts[w] for w in words])
    forms = {r[0]: r for r in got}
    for i, w in enumerate(words):
        others = np.flatnonzero(near[i])
        best = min(others, key=lambda j: (-n[j], words[j]), default=None)
        form = words[best] if best is not None and n[best] >= 10 * n[i] else None
        assert forms[w][1] == form and forms[w][4] == len(others) and forms[w][5] == counts.get(form)
        assert forms[w][2] == (w if form is None else forms[form][2])
