"""WARC archives: writing pages, normalising monolithic gzip files, reading records by index.

``write_archives`` stores pages the way careless writers do, as one gzip stream for a whole
file. ``normalise`` inflates such a file once, from front to back, rewrites every record as a
gzip member of its own and writes a sidecar index (offset, length, record id) beside it.
``read_records`` goes by the index: each record is read and inflated by itself.

Files go through pyarrow's file systems below a folder that all executors share. A task names
its files anew on every attempt and only the files that its result lists count, so a lost
executor or a repeated task leaves unread files behind, never a mixed archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed

FILE_BYTES, READ_BYTES, LEVEL = 64 << 20, 1 << 20, 3
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER = 31  # zlib window bits of a gzip stream


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit where the payload is None."""
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""]
    block = b"\r\n".join(head) + (payload or b"")
    fields = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if payload is None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def inflated(stream) -> Iterator[bytes]:
    """The whole of a gzip file, of one member or many, piece by piece."""
    unzip = zlib.decompressobj(_MEMBER)
    while data := stream.read(READ_BYTES):
        while data:
            yield unzip.decompress(data, READ_BYTES * 4)
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(_MEMBER)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; holds one record at a time."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(int(x[15:]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def member(data: bytes) -> bytes:
    zipper = zlib.compressobj(LEVEL, zlib.DEFLATED, _MEMBER)
    return zipper.compress(data) + zipper.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        out = zipper = path = None
        room = count = 0

        def closed() -> pa.RecordBatch:
            out.write(zipper.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "size", "sha1", "refers_to")]
                if out is None:
                    files.create_dir(base)
                    path, room, count = f"{base}/{uuid.uuid4().hex}.warc.gz", FILE_BYTES, 0
                    out, zipper = files.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, _MEMBER)
                data = record(*row[:4], base64.b32encode(bytes.fromhex(row[4])).decode(), row[5])
                out.write(zipper.compress(data))
                room, count = room - len(data), count + 1
                if room < 0:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", text_col: str = "html",
                   url_col: str = "url") -> DataFrame:
    """(path, records) of monolithic archives holding a record for each row of ``pages``.

    Of equal payloads of ``min_bytes`` or more the largest id is the response and the others
    revisit it, as do not rows that repeat that id: they are responses too. Smaller payloads
    are all responses. A null payload is empty; a null id is below all others.
    """
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("sha1"))
    first = rows.groupBy("sha1").agg(F.max("page_id").alias("newest"))
    rows = rows.join(first, "sha1")
    response = (F.col("size") < min_bytes) | F.col("page_id").eqNullSafe(F.col("newest"))
    rows = rows.select("page_id", "url", F.when(response, F.col("payload")).alias("payload"), "size", "sha1",
                       F.when(~response, F.col("newest")).alias("refers_to"))
    return checkpointed(rows.mapInArrow(_writer(folder), "path string, records long"))


def _normaliser(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                target = f"{source.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
                offset, lines = 0, []
                with files.open_input_stream(source, compression=None) as raw, files.open_output_stream(target, compression=None) as out:
                    for data in split_records(inflated(raw)):
                        zipped = member(data)
                        out.write(zipped)
                        lines.append(f"{offset}\t{len(zipped)}\t{parse(data)[0]['WARC-Record-ID']}\n")
                        offset += len(zipped)
                with files.open_output_stream(f"{target}.idx", compression=None) as out:
                    out.write("".join(lines).encode())
                yield pa.RecordBatch.from_pydict({"path": [target], "records": [len(lines)]})

    return run


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, records) of archives with a member for each record; the index is at path + '.idx'."""
    files = archives.select("path")
    return checkpointed(files.repartition(max(1, files.count())).mapInArrow(_normaliser(folder), "path string, records long"))


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_record(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record as stored."""
    fields, block = parse(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what its header says")
    return _page(fields["WARC-Record-ID"]), size, digest, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_stream(f"{path}.idx", compression=None) as f:
                    index = [line.split("\t") for line in f.read().decode().splitlines()]
                rows = []
                with files.open_input_file(path) as f:
                    for offset, length, name in index:
                        row = read_record(zlib.decompress(f.read_at(int(length), int(offset)), _MEMBER))
                        if _name(row[0]) != name:
                            raise ValueError(f"{path}: the index points to another record at {offset}")
                        rows.append(row)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _RECORD.types)], schema=_RECORD)

    return run


def read_records(normalised: DataFrame, folder: str) -> DataFrame:
    """All records of normalised archives, each read through the index and checked against its digest."""
    files = normalised.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(
        _reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
