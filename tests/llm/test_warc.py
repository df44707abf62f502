import base64
import glob
import gzip
import hashlib
import io

import pytest

from logspark.llm import warc as W
from logspark.llm.queries import QUERIES
from logspark.session import scratch_path


def expected(rows, min_bytes=0):
    newest = {}
    for i, payload in rows:
        newest[payload or ""] = max(newest.get(payload or "", -1), -1 if i is None else i)
    out = []
    for i, payload in rows:
        data = (payload or "").encode()
        top = newest[payload or ""]
        response = len(data) < min_bytes or (-1 if i is None else i) == top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top))
    return sorted(out, key=str)


def trip(spark, rows, min_bytes=0):
    folder = scratch_path(spark, "warc-test")
    df = spark.createDataFrame([(i, f"http://x/{i}\r\nä", h, 1) for i, h in rows], "page_id long, url string, html string, path int").repartition(3)
    normal = W.normalise(W.write_archives(df, folder, min_bytes), folder)
    return sorted(map(tuple, W.read_records(normal, folder).collect()), key=str), folder


def test_records_come_back_with_ties_nulls_and_thresholds(spark, monkeypatch):
    rows = [(1, "same ä"), (2, "same ä"), (5, "same ä"), (5, "same ä"), (3, None), (4, ""), (None, "lone"), (6, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
            (7, "x" * 3_000_000), (None, "same ä")]
    for min_bytes in (0, 6):
        got, folder = trip(spark, rows, min_bytes)
        assert got == expected(rows, min_bytes)
    assert trip(spark, [])[0] == []
    whole = [f for f in glob.glob(f"{folder}/*.warc.gz") if "members" not in f]
    assert whole
    for f in whole:
        assert gzip.open(f).read().startswith(b"WARC/1.1\r\n")


def test_every_member_stands_alone(spark):
    _, folder = trip(spark, [(i, f"page {i % 4}") for i in range(20)])
    found = 0
    for path in glob.glob(f"{folder}/*.members.warc.gz"):
        data = open(path, "rb").read()
        for line in open(f"{path}.idx"):
            offset, length, name = line.rstrip("\n").split("\t")
            fields, _ = W.parse(gzip.decompress(data[int(offset):int(offset) + int(length)]))
            assert fields["WARC-Record-ID"] == name
            found += 1
    assert found == 20


def test_streams_of_any_cut_and_broken_archives():
    records = [W.record(i, None, b"y" * i * 1000, i * 1000, "D", None) for i in range(30)]
    one, many = gzip.compress(b"".join(records)), b"".join(map(W.member, records))
    for data in (one, many):
        assert list(W.split_records(W.inflated(io.BytesIO(data)))) == records
    assert list(W.split_records(bytes([b]) for b in b"".join(records[:3]))) == records[:3]
    with pytest.raises(ValueError):
        list(W.split_records([b"".join(records)[:-5]]))
    with pytest.raises(ValueError):
        W.read_record(W.record(1, None, b"abc", 3, "WRONG", None))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    assert sorted(map(tuple, QUERIES["op9_warc"](spark, sf).collect()), key=str) == expected(rows)
