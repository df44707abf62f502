import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from logspark.llm import simhash_dedup as S
from logspark.llm.components import components


def brute(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    out = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) if out >> 63 else out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB É\t\n\x0b\x1c xZ", max_size=80))
def test_fingerprint_equals_brute_force(text):
    assert S.simhash(text.encode()) == brute(text)


def test_blocks_of_a_long_text_agree(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = S.simhash(text.encode())
    real = S.word_blocks
    monkeypatch.setattr(S, "word_blocks", lambda data: real(data, 64))
    assert S.simhash(text.encode()) == whole == brute(text)


def _reach(prints, bits):
    left, out = set(prints), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            near = {y for y in left if (x ^ y).bit_count() <= bits}
            left -= near
            todo += near
        for x in group:
            out[x] = min(group)
    return out


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    prints = {0, -1, 1 << 62}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add((x := x ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3])))) & (2**64 - 1))
    prints = {p - 2**64 if p >> 63 and p > 0 else p for p in prints}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for bits in (0, 1, 2, 3, 4):
        want = {(min(a, b), max(a, b)) for a in prints for b in prints if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
        got = {(min(r), max(r)) for r in S.close_fingerprints(df, bits).collect()}
        assert got == want


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (7, 8), (8, 7), (None, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_with_nulls_ties_and_clashing_columns(spark):
    long = "lorem ipsum " * 30000
    rows = [(5, None, 1), (2, "", 1), (9, "a b c d", 1), (4, "a b c d", 1), (4, "a b c d", 1), (None, "solo words here", 1),
            (1, long, 1), (3, long + "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    apart = ((brute(long) ^ brute(long + "x")) & (2**64 - 1)).bit_count()
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in S.near_duplicates(docs).collect())
    assert got == sorted([(5, 0, 2), (2, 0, 2), (9, brute("a b c d"), 4), (4, brute("a b c d"), 4), (4, brute("a b c d"), 4),
                          (-1, brute("solo words here"), None), (1, brute(long), 1), (3, brute(long + "x"), 1 if apart <= 2 else 3)])
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    far, other = "one two three four five", "quite some other words here at last"
    rows = [(5, far, 1), (9, far, 2), (9, far, 2), (5, other, 3), (3, other, 4), (7, "", 5), (8, None, 6), (None, far, 7), (5, far, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __h int")
    got = S.keep_first(docs)
    assert got.columns == docs.columns
    want = [(3, other, 4), (5, far, 1), (7, "", 5), (None, far, 7)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    again = spark.createDataFrame([(5, far, 1), (5, other, 2), (5, other, 3)], docs.schema)
    assert S.keep_first(again).count() == 2
    assert S.keep_first(spark.createDataFrame([(8, None, 1), (8, "", 2)], docs.schema)).count() == 1
    assert S.keep_first(docs.limit(0)).count() == 0


def test_ties_are_broken_by_the_other_columns(spark):
    rows = [(1, "a b c", src, i) for i, src in enumerate(["web", "books", None, "news"])]
    schema = "doc_id long, text string, __first_id string, __near_dedup_hash int"
    kept = {tuple(S.keep_first(spark.createDataFrame(list(r), schema)).collect()[0]) for r in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(kept) == 1 and S.keep_first(spark.createDataFrame(rows, schema)).columns == [c.split()[0] for c in schema.split(", ")]


def test_query_equals_brute_force(spark):
    from logspark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r[0]: brute(r[1] or "") & (2**64 - 1) for r in docs}
    low = {}
    for i in sorted(prints):
        low.setdefault(prints[i], i)
    reach = _reach(set(prints.values()), 2)
    first = {}
    for p, label in reach.items():
        first[label] = min(first.get(label, low[p]), low[p])
    want = {(i, f"{p:016x}", first[reach[p]]) for i, p in prints.items()}
    got = QUERIES["op3_simhash_near_dedup"](spark, sf).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
