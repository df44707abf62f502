import zlib

import numpy as np
from pyspark.sql import functions as F

from logspark.llm import quality as Q
from logspark.llm.queries import QUERIES


def test_held_out_rule(spark):
    ids = [None, 0, 7, -3, 123456789]
    got = dict(spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", Q.held_out()).collect())
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_few_or_one_sided_labels():
    assert Q.fit([]).score([b"x"]).tolist() == [0.5]
    assert Q.fit([(b"x", 1)]).score([b"", b"y"]).tolist() == [1.0, 1.0]
    model = Q.fit([(b"some good words here %d" % i, 1) for i in range(9)] + [(b"%% && !! ## %d" % i, 0) for i in range(9)])
    scores = model.score([b"", b"some good words", b"%% && !! ##", b"a" * 3_000_000])
    assert ((scores >= 0) & (scores <= 1)).all() and scores[1] > 0.5 > scores[2]


def test_accuracy_on_held_out_rows_and_labels_out_of_reach(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = QUERIES["op7_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out and quality is not null").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    order = s[y == 1][:, None] > s[y == 0][None]
    assert order.mean() > 0.97
    assert (np.array([r["predicted"] for r in rows]) == (s >= 0.3)).all()
    assert np.mean((s >= 0.3)[y == 1]) > 0.98 and np.mean((s < 0.3)[y == 0]) > 0.7
    swapped = labels.selectExpr("doc_id", f"CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert np.array_equal(Q.train(docs, labels).weights, Q.train(docs, swapped).weights)


def test_rows_with_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (1, None, 3.0), (None, "text", 1.0), (4, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, None), (None, 0)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    got = Q.classify(docs, model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert Q.classify(docs.limit(0), Q.train(docs.limit(0), labels.limit(0))).count() == 0


def test_long_texts_are_used_whole(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels)
    bad = [r["text"] for r in docs.join(labels, "doc_id").where(Q.held_out() & F.expr("quality = 0 and text <> ''")).orderBy("doc_id").collect()]
    for size in (50_000, 100_000, 200_000, 500_000):
        order, long = np.random.default_rng(size), []
        for _ in range(25):
            text = ""
            while len(text) < size:
                text += bad[order.integers(len(bad))] + "\n"
            long.append(text[:size].encode())
        assert (model.score(long) >= Q.THRESHOLD).sum() <= 1, size


def test_sample_size_leaves_the_share_of_good_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = [(r["text"] or "").encode() for r in docs.join(labels, "doc_id").where(Q.held_out() & F.expr("quality in (0, 1)")).collect()]
    whole, small = (Q.train(docs, labels, per_class=n).score(texts).mean() for n in (2000, 400))
    assert abs(whole - small) < 0.01
    a, b = ([(b"some good words here %d" % i, 1) for i in range(40)], [(b"%% && !! ## %d" % i, 0) for i in range(40)])
    assert np.isfinite(Q.fit(a + b[:3]).weights).all()
