"""WARC archives with a Zstandard dictionary.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from the archive's first
records; every record is a Zstandard frame of its own, compressed with it. Records with equal payloads are written once:
the one with the least page_id is the response, the others are revisits that refer to it.

Archives are written by Spark's text writer, one archive a row and a file, as bytes: its line separator is set to an
empty skippable frame, which decoders pass over. So archives go through the committer to any file system that Spark
writes to, and a lost task leaves nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.llm.common import bound_arrow, fresh_path, table, written

# Fixed values of the format.
DICTIONARY, SKIP = 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a dictionary, of the records that it is built from, and of an archive's records before compression, at most (a longer record has its own archive).
DICT_BYTES, TRAIN_BYTES, ARCHIVE_BYTES = 32 << 10, 2 << 20, 32 << 20
LEVEL = 3
#: Digests of repeated payloads (about 100 bytes each) that are sent to every executor at most; more are joined by a shuffle.
SENT_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, name: str | None = None) -> bytes:
    """One WARC record. refers_to: None for a response; for a revisit the page_id of the record referred to, in a list."""
    name = name or digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{name}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~''')}")
    if refers_to:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to[0]}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], dict_bytes: int = DICT_BYTES) -> bytes:
    """The archive of these records. With too few or too uniform ones to train on, their own bytes are the dictionary."""
    import zstandard

    sample, size = [], 0
    for x in records:
        sample.append(x[: 128 << 10])
        size += len(sample[-1])
        if size >= TRAIN_BYTES:
            break
    try:
        words = zstandard.train_dictionary(min(dict_bytes, max(512, size // 8)), sample, threads=0, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        words = b"".join(sample)[:dict_bytes]
    out = [struct.pack("<II", DICTIONARY, len(words)), words]
    engine = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    out += [engine.compress(x) for x in records]
    return b"".join(out)


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one decoded frame each; skippable frames are passed over. A broken frame raises."""
    import zstandard

    at, engine = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY:
                engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        frame, parts = engine.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("archive ends inside a frame")
            piece = data[at : at + (1 << 15)]
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def read_record(data: bytes) -> dict:
    """Headers and payload of a record; the payload's length and digest are held against what the headers say."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(":")[1]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length"))
    name = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != name):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
    page = lambda x: None if x is None or x == "<urn:page:None>" else x.removeprefix("<urn:page:").removesuffix(">")
    return {"id": page(headers["WARC-Record-ID"]), "bytes": size, "digest": name, "type": headers["WARC-Type"], "refers_to": page(headers.get("WARC-Refers-To")), "payload": payload}


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for page_id, url, payload, first, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(record(page_id, url, payload, None if first else [first_id]))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["value"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Writes a record for every row of pages to archives under path.

    Payload: html_col in UTF-8, empty if null. Of equal payloads of at least `least` bytes the row with the least id is the
    response (all rows with that id, should it repeat; nulls last), the others revisit it; smaller payloads are all responses.
    Extra columns are ignored; an empty table writes no archive. Very long payloads get an archive of their own."""
    bound_arrow(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    name = F.concat(F.sha1("payload"), F.lit("-"), F.length("payload"))
    # ids of payloads that occur more than once: few, and small without the payloads
    ids = rows.select("id", name.alias("name")).where(F.substring_index("name", "-", -1).cast("long") >= least)
    again = written(ids.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1").select("name", "least"), "warc-repeated")
    if again.count() <= SENT_ROWS:
        again = F.broadcast(again)  # of checked size; payloads then stay where they are, however often one repeats
    named = rows.withColumn("name", name).join(again, "name", "left")
    first = F.col("least").isNull() | F.coalesce(F.col("id") == F.col("least"), F.lit(False))
    kind = named.select("id", "url", "payload", first.alias("first"), "least")
    blobs = kind.mapInArrow(_write, "value binary")
    blobs.select(F.col("value").cast("string")).write.option("lineSep", SKIP).option("maxRecordsPerFile", 1).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "bytes", "digest", "type", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for content in batch.column(0):
            rows = [{k: r[k] for k in names} for r in map(read_record, frames(content.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """id (string), bytes, digest, type, refers_to of every record under path; every response is checked against its digest. No archive: no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, "id string, bytes long, digest string, type string, refers_to string")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, path := fresh_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(
        F.col("id").cast(kind).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to")
    )


OP3_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as n, sha1(h) as x, min(page_id) over (partition by h) as least, count(*) over (partition by h) as m from p)
select page_id, n as payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::bigint) >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as payload_digest,
 case when m = 1 or page_id = least then 'response' else 'revisit' end as record_type,
 case when m = 1 or page_id = least then null else least end as refers_to
from d
"""
