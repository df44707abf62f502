import os

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logspark.llm import token_counts as C
from logspark.llm.queries import QUERIES, TOKENIZERS

SF = "/root/testdata/sf0.001"
PATH = os.path.join(TOKENIZERS, "piece_bpe_32k.model")


def greedy(word, first, inside):
    """Longest match from the left, piece by piece."""
    at, n = 0, 0
    while at < len(word):
        pieces = inside if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return C.UNKNOWN
        at, n = end, n + 1
    return n


pieces = st.sets(st.text(alphabet="abc", min_size=1, max_size=4), max_size=12)


@settings(max_examples=400, deadline=None)
@given(pieces, pieces, st.text(alphabet="abcd", max_size=12))
def test_automaton_equals_greedy_matching(first, inside, word):
    assert C.Automaton(first, inside).count(word) == greedy(word, first, inside)


def test_query_equals_greedy_matching(spark):
    first, inside = map(set, C.read_pieces(PATH))
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op2_token_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        words = regex.findall(C.WORD, texts[r["doc_id"]] or "")
        counts = [greedy(w, first, inside) for w in words]
        assert tuple(r)[1:] == (len(words), sum(map(abs, counts)), counts.count(C.UNKNOWN))


def test_nulls_long_words_blocks_and_empty_table(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "a" * 300000 + " " + "the cat, " * 9000, 1)], "doc_id long, text string, n_words int")
    rows = docs.select("doc_id", C.counts_column(spark, F.col("text"), PATH).alias("c")).select("c.*").collect()
    assert sorted(r["n_words"] for r in rows) == [0, 0, 27001]
    assert docs.limit(0).select(C.counts_column(spark, F.col("text"), PATH)).count() == 0
    counter = C.Counter(C.Automaton(*C.read_pieces(PATH)))
    whole = counter.text("some words, again some words " * 50, regex.compile(C.WORD))
    monkeypatch.setattr(C, "BLOCK_WORDS", 5)
    monkeypatch.setattr(C, "MEMO_WORDS", 2)
    assert C.Counter(counter.automaton).text("some words, again some words " * 50, regex.compile(C.WORD)) == whole
