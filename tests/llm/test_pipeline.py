import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline as CP
from logspark.llm import byte_bpe, mixing, quality
from logspark.session import scratch_path
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash_dedup import _reach, brute

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = [docs]
    for name, stage in CP.STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, inputs[-1], SF).write.parquet(path)
        inputs.append(spark.read.parquet(path))
    for out in inputs[1:-1]:
        assert out.columns == docs.columns
    texts = [sorted((r["doc_id"], r["text"] or "") for r in x.select("doc_id", "text").collect()) for x in inputs[:-1]]

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.score([t.encode() for _, t in texts[0]])
    assert texts[1] == [d for d, s in zip(texts[0], scores) if s >= quality.THRESHOLD] and 0 < len(texts[1]) < len(texts[0])

    gone, want = brute_lines(texts[1]), []
    for i, text in texts[1]:
        lines = text.split("\n")
        left = [line for n, line in enumerate(lines) if (i, n) not in gone]
        if len(left) == len(lines) or "".join(left).strip(" "):
            want.append((i, "\n".join(left)))
    assert texts[2] == want

    prints = {i: brute(t) & (2**64 - 1) for i, t in texts[2]}
    reach, first = _reach(set(prints.values()), 2), {}
    for i in sorted(prints):
        first.setdefault(reach[prints[i]], i)
    assert texts[3] == [(i, t) for i, t in texts[2] if first[reach[prints[i]]] == i]

    copies = {r["id"]: r["copies"] for r in mixing.mix_plan(inputs[3]).collect()}
    assert texts[4] == [d for d in texts[3] for _ in range(copies[d[0]])]

    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in inputs[5].collect())
    assert got == sorted((i, len(ids), tuple(ids)) for i, t in texts[4] for ids in [tok.encode_ordinary(t)])


def test_encoding_stage_decodes_its_ids(spark):
    rows = [(1, "plain words", "a"), (2, "é𐍈\u2028 <|x|>\r\n\x00", "b"), (3, "", "a"), (4, None, "a"), (1, "plain words", "a")]
    got = CP.encoding_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    want = [(i, hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t, _ in rows]
    assert sorted((r["doc_id"], r["decoded_sha256"], r["round_trip"]) for r in got) == sorted(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
