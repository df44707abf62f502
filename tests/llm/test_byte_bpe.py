import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logspark.llm import byte_bpe as B
from logspark.llm.queries import QUERIES, byte_bpe_tokenizer

SF = "/root/testdata/sf0.001"
RANKS = B.read_ranks(P.path("byte_bpe_50k.tiktoken"))
CODEC = B.ByteBpe(RANKS, P.PATTERN)
WANT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_perfect_hash_is_minimal_and_finds_only_its_keys():
    keys = list(RANKS)
    assert sorted(CODEC.table.key_at.tolist()) == list(range(len(keys)))
    assert CODEC.table.find(keys).tolist() == list(range(len(keys)))
    assert set(CODEC.table.find([k + b"\xff\xfe" for k in keys[:3000]]).tolist()) == {-1}
    assert B.MinimalPerfectHash([]).find([b"a"]).tolist() == [-1]
    assert B.MinimalPerfectHash([b"a"]).find([b"a", b"b"]).tolist() == [0, -1]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_like_the_public_library(text):
    assert CODEC.encode(text).tolist() == WANT.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text).tolist()) == text.encode()


def test_long_runs_and_small_blocks(monkeypatch):
    text = "a" * 3000 + " " + "é" * 2000 + "  \n" + "word " * 5000 + "𐍈" * 50
    want = WANT.encode_ordinary(text)
    assert CODEC.encode(text).tolist() == want
    monkeypatch.setattr(B, "BLOCK_TOKENS", 7)
    monkeypatch.setattr(B, "MEMO_TOKENS", 5)
    assert B.ByteBpe(RANKS, P.PATTERN).encode(text).tolist() == want


def test_short_and_long_merges_agree():
    rng = np.random.default_rng(3)
    tokens = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in range(1, 90)] + [rng.bytes(n) for n in range(1, 90)] + [b"\0", b"\0" * 40, b"aaaaaaa"]
    for t in tokens:
        assert CODEC._merge_short(t) == CODEC._merge_long(t)
        assert CODEC.merge(t) == CODEC._merge_long(t) and CODEC.decode(CODEC.merge(t)) == t


def test_frequent_pretokens_stay_in_the_memo(monkeypatch):
    codec, asked, find = B.ByteBpe(RANKS, P.PATTERN, CODEC.table), Counter(), CODEC.table.find
    monkeypatch.setattr(B, "MEMO_TOKENS", 40)
    monkeypatch.setattr(codec.table, "find", lambda keys: asked.update(keys) or find(keys))
    for i in range(60):
        text = "often used " + " ".join(f"rare{'abcdefghij'[i % 10]}{'klmnopqrst'[j]}{'uvwxyz'[i // 10]}" for j in range(5))
        assert codec.encode(text).tolist() == WANT.encode_ordinary(text)
    assert asked[b" used"] == asked[b"often"] == 1
    assert len(asked) > 300 and len(codec.memo) + len(codec.older) <= 40 + 2 * 7


def test_columns_round_trip_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello  world\n", 0), (3, "Hello  world\n", 0)], "doc_id long, text string, ids int")
    t = byte_bpe_tokenizer(spark)
    ids = df.select("doc_id", "text", B.encode_column(F.col("text"), t).alias("x"))
    rows = ids.select("*", B.decode_column(F.col("x"), t).alias("back")).collect()
    for r in rows:
        assert r["x"] == (None if r["text"] is None else WANT.encode_ordinary(r["text"]))
        assert r["back"] == (None if r["text"] is None else r["text"].encode())


def test_query_equals_the_public_library(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_byte_bpe"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for i, text in texts:
        ids = WANT.encode_ordinary(text or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_encoded_rows_in_small_batches(spark, monkeypatch):
    texts = [None, "", "Hello  world\n", "Hello  world\n", "é𐍈 <|x|>\r\n\x00", "word " * 50_000, "x"]
    df = spark.createDataFrame([(i, t, {"a": i}) for i, t in enumerate(texts)], "doc_id long, text string, `odd name` map<string,int>").coalesce(1)
    monkeypatch.setattr(B, "OUT_BYTES", 8)
    monkeypatch.setattr(B, "MEMO_BYTES", 500)
    got = B.encoded(df, byte_bpe_tokenizer(spark)).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [WANT.encode_ordinary(t or "") for t in texts]
    assert all(r["n_tokens"] == len(r["ids"]) and r["round_trip"] and r["odd name"] == {"a": r["doc_id"]} for r in got)
    assert [r["decoded_sha256"] for r in got] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    t = byte_bpe_tokenizer(spark)
    assert B.encoded(df.limit(0), t).count() == 0
    assert df.limit(0).select(B.round_trip_column(F.col("text"), t).alias("r")).count() == 0


def test_missing_vocabulary_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        byte_bpe_tokenizer(spark, "/nowhere")
