import random
import re
from collections import Counter

import pytest
import zstandard

from logspark.llm import compression_rules as C
from logspark.llm.queries import QUERIES


def brute(text):
    """The measures by plain loops over characters, words and lines."""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    spots = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if spots[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dups = sum(1 for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c") and x in lines[:i])
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def verdict(text):
    """The bands' verdict with one-shot compression."""
    data, size = text.encode(), lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)
    if len(data) < 64:
        return True
    inside = lambda b: C.limits_at(len(b))[0] <= size(b) <= C.limits_at(len(b))[1]
    chunks = [b for i in range(0, len(data), 4096) if len(b := data[i:i + 4096]) >= 64]
    low = sum(len(b) for b in chunks if size(b) < C.limits_at(len(b))[0])
    high = sum(len(b) for b in chunks if size(b) > C.limits_at(len(b))[1])
    return inside(data) and max(low, high) <= 0.3 * len(data)


ODD = [None, "", " \t\n", "one", "a\n\n a\na\n\t\na", "é𐍈 ×÷ # $ %%", "w " * 30, "a b c d e f g h " * 2, "\x0b".join("abcdefghijklmnopqrstuvw"),
       "x\x00y " * 40, " ".join(["z"] * 40)]


def test_measures_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice("a b cc d\n e".split(" ")) for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (1, "again", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((tuple(r) for r in C.judge(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    assert got == sorted(((i, *brute(t or "")) for i, t, _ in rows), key=str)
    assert C.keep_good(docs).columns == docs.columns
    assert C.judge(docs.limit(0)).count() == C.keep_good(docs.limit(0)).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8])
def test_windows_of_any_length(window):
    rng = random.Random(window)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(40))]
        spots = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
        hit = {j for i in range(len(words) - window + 1) if spots[tuple(words[i:i + window])] > 1 for j in range(i, i + window)}
        assert C.repeated_words(words, window) == len(hit)


def test_limits_run_between_the_table_rows():
    assert C.limits_at(1) == C.LIMITS[0][1:] and C.limits_at(10**9) == C.LIMITS[-1][1:]
    for size, low, high in C.LIMITS:
        assert C.limits_at(size) == pytest.approx((low, high))
    assert C.limits_at(512) == pytest.approx([(C.LIMITS[1][i] + C.LIMITS[2][i]) / 2 for i in (1, 2)])


def test_bands_reject_repetition_and_noise_at_every_length():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for n in (300, 3000, 30_000, 300_000):
        noise = " ".join("".join(rng.choice(letters) for _ in range(12)) for _ in range(n // 13))
        base = [rng.choice(vocabulary) for _ in range(7)]
        looped = " ".join(w for _ in range(n // 40) for w in rng.sample(base, 7))
        assert C.measure(noise.encode()).verdict == "incompressible"
        assert C.measure(looped.encode()).verdict in ("repetitive", "base")
    prose = " ".join(rng.choice(vocabulary[:400]) for _ in range(4000)).encode()
    assert C.measure(prose).verdict == "kept"
    half = prose + b" " + " ".join("".join(rng.choice(letters) for _ in range(12)) for _ in range(1000)).encode()
    assert C.measure(half).verdict == "incompressible" and C.measure(half).ratio < C.limits_at(len(half))[1]
    assert C.measure(b"plain words " * 400_000).verdict == "base"


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_compression_rules"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert tuple(r)[1:7] == want
        assert r["kept"] == (not want[-1] and verdict(docs[r["doc_id"]]))
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert all(r["kept"] for r in rows if r["doc_id"] in good and not r["base_failed"])
    assert sum(not r["kept"] and not r["base_failed"] for r in rows) > 0
