"""Operator 10. WARC archives as dictionary-compressed Zstandard.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on records of the archive
itself; each record follows as one frame of its own. Archives are rows (archive, content): `content` is the file byte
for byte. Of the records of equal payloads of at least `least` bytes, the one of the largest page_id is a response,
the others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipyard.llm.common import scratch, table

#: Frame magics and the revisit profile of the formats.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST, RECORDS, BYTES, DICTIONARY = 1000, 2000, 8 << 20, 64 << 10


def _uri(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(value: str | None) -> str:
    return "" if value is None else "".join(ch if ch > " " and ch != "\x7f" else f"%{ord(ch):02X}" for ch in value)


def record(page_id, url: str | None, payload: bytes | None, digest: str, size: int, refers_to=None) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit without (payload None)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes], dictionary_bytes: int = DICTIONARY) -> bytes:
    """The archive of the records. With too little to train on, the dictionary is the beginning of the first records."""
    total = sum(map(len, records))
    size = min(dictionary_bytes, max(256, total // 20))
    step = max(1, len(records) // 400)
    samples = [r[: 4 * size] for r in records[::step]]
    try:
        held = zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        held = zstandard.ZstdCompressionDict(b"".join(r[:512] for r in records)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = held.as_bytes()
    packer = zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw + b"".join(packer.compress(r) for r in records)


def unpack(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    view, at, held = memoryview(content), 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        raw, at = bytes(view[8 : 8 + size]), 8 + size
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        held = zstandard.ZstdCompressionDict(raw)
    unpacker = zstandard.ZstdDecompressor(dict_data=held)
    while at < len(content):
        one = unpacker.decompressobj()
        out = one.decompress(view[at:])
        at = len(content) - len(one.unused_data)
        yield out


def parse(raw: bytes) -> dict:
    """Header fields (lower case) of a record, with its payload under `payload`."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload"] = payload
    fields["http-length"] = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return fields


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, size, refers_to. Null html is empty. Rows that tie on the largest page_id of a payload are all responses; a null page_id is less than any other, and with no other id there is nothing to refer to."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    # One row per payload that repeats: partial sums meet before rows move, so a payload held by a third of all pages costs no more.
    last = base.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n")
    newer = (F.col("newest").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("newest"))
    joined = base.join(last, ["digest", "size"], "left")
    return joined.select("page_id", "url", F.when(~F.coalesce(newer, F.lit(False)), F.col("html")).alias("html"), "digest", "size", F.when(newer, F.col("newest")).alias("refers_to"))


def write(planned: DataFrame, records: int = RECORDS, most: int = BYTES) -> DataFrame:
    """(archive, content) rows; an archive closes at `records` records or `most` bytes of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            for page_id, url, html, digest, length, other in zip(pdf["page_id"].astype(object), pdf["url"], pdf["html"], pdf["digest"], pdf["size"], pdf["refers_to"].astype(object), strict=True):
                one = record(None if pd.isna(page_id) else int(page_id), url, None if html is None else html.encode(), digest, length, None if pd.isna(other) else int(other))
                held.append(one)
                size += len(one)
                if len(held) >= records or size >= most:
                    yield pd.DataFrame({"archive": [f"part-{part:05d}-{n:05d}.warc.zst"], "content": [pack(held)]})
                    n, held, size = n + 1, [], 0
        if held:
            yield pd.DataFrame({"archive": [f"part-{part:05d}-{n:05d}.warc.zst"], "content": [pack(held)]})

    return planned.select("page_id", "url", "html", "digest", "size", "refers_to").mapInPandas(run, "archive string, content binary")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload of every record. Of a response, digest and length are computed from what was read; of a revisit they are the header's. Without `payloads` that column is null."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def number(uri: str | None) -> int | None:
        digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for f in map(parse, unpack(content.as_py())):
                    kind, payload = f["warc-type"], f["payload"]
                    full = kind == "response"
                    rows.append({"page_id": number(f["warc-record-id"]), "url": f["warc-target-uri"], "record_type": kind, "refers_to": number(f.get("warc-refers-to")), "payload_digest": hashlib.sha1(payload).hexdigest() if full else f["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": len(payload) if full else f["http-length"], "payload": payload if full and payloads else None})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file of its own to a folder that all executors mount; returns archive and bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for pdf in batches:
            for name, content in zip(pdf["archive"], pdf["content"], strict=True):
                spare = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
                with open(spare, "wb") as f:
                    f.write(content)
                os.replace(spare, f"{folder}/{name}")
            yield pd.DataFrame({"archive": pdf["archive"], "bytes": pdf["content"].map(len)})

    return archives.mapInPandas(run, "archive string, bytes long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch(write(plan(table(spark, sf_dir, "pages"))), "warc")
    return read(archives, payloads=False).drop("payload", "url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS newest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM d
"""
