"""WARC archives: writing, reading, and reassembly of segmented records.

Writing: one record per row. Of rows with equal payloads of at least `min_revisit` bytes that with the smallest key is a
`response`, the others are `revisit` records that refer to it. A response block is an HTTP response whose body is in
chunked transfer framing; a block of more than `segment` bytes is cut into a first record and `continuation` records
(WARC-Segment-Number, WARC-Segment-Origin-ID, and WARC-Segment-Total-Length on the last). Archives are gzipped files
written by Spark into the folder that all executors share; a file holds at most `records` records of at most `segment`
bytes, so that it can be read as a whole within a known bound.

Reading: every archive is cut into records by their Content-Length. Continuations are grouped by the record they
continue, put in order of their numbers, their total length is verified, and the chunked framing is decoded. A revisit
takes the payload's length from the response it refers to.

Defined results: a null payload is empty; where several rows have the smallest key of a payload all are responses;
rows with a null key come after all others; damaged records (a missing segment, a wrong length, broken framing) have
`problem` set and no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, shared_dir, until_exit

CRLF = b"\r\n"
SEGMENT, RECORDS, CHUNK = 1 << 16, 512, 1 << 13


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut")
        out.append(body[at : at + size])
        at += size + 2


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + CRLF


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b('|'.join(map(str, parts)).encode(), digest_size=16).digest())}>"


def _clean(value: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", "", value or "")


def records_of(key: int | None, number: int, uri: str | None, payload: bytes, refers_to: int | None, segment: int) -> list[bytes]:
    """The records (header and block, without the closing blank lines) of one row."""
    digest = "sha1:" + sha1_base32(payload)
    name = _urn("record", number)
    common = [("WARC-Target-URI", _clean(uri) or "urn:none"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Payload-Digest", digest), ("X-Key", "" if key is None else str(key))]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Key", str(refers_to)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
        return [_header(fields) + block]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for i, part in enumerate(cuts, 1):
        fields = [("WARC-Type", "response" if i == 1 else "continuation"), ("WARC-Record-ID", name if i == 1 else _urn("segment", number, i)), *common]
        if len(cuts) > 1:
            fields.append(("WARC-Segment-Number", str(i)))
            if i > 1:
                fields.append(("WARC-Segment-Origin-ID", name))
            if i == len(cuts):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(part)))]
        out.append(_header(fields) + part)
    return out


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of an uncompressed archive."""
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == CRLF:
            at += 2
            continue
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(fields["content-length"])
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def write_warc(df: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", min_revisit: int = 0, segment: int = SEGMENT, records: int = RECORDS) -> None:
    """Writes df's rows as gzipped archives below path."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{uri}`").cast("string").alias("_uri"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("_payload"))
    rows = rows.withColumn("_sha", F.sha1("_payload")).withColumn("_size", F.octet_length("_payload"))
    shared = rows.filter(F.col("_size") >= min_revisit).groupBy("_sha", "_size").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    shared = materialise(shared, "shared")  # written, so that the join can deal out a payload that very many rows have
    rows = rows.join(shared, ["_sha", "_size"], "left").withColumn("_refers", F.when(~F.col("_key").eqNullSafe(F.col("_first")), F.col("_first")))
    rows = rows.withColumn("_number", F.monotonically_increasing_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("_key", "_number", "_uri", "_payload", "_refers")), strict=True):
                made = records_of(*row, segment)
                held += made
                size += sum(map(len, made))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    # the text writer passes bytes through as they are; its line separator is the end of a WARC record
    made = rows.select("_key", "_number", "_uri", "_payload", "_refers").mapInArrow(work, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
    discard(shared)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives (.gz or plain, whatever their names) below path: id, type, key, digest, refers_to, origin, number, total, block."""
    import zlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "type", "key", "digest", "refers_to", "origin", "number", "total", "block"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for raw in batch.column("content"):
                raw = raw.as_py()
                parts = []
                while raw[:2] == b"\x1f\x8b":  # members may follow each other
                    unzip = zlib.decompressobj(31)
                    parts.append(unzip.decompress(raw))
                    raw = unzip.unused_data
                out = []
                number = lambda v: int(v) if v not in (None, "") else None
                for f, block in parse_records(b"".join(parts) or raw):
                    out.append((f.get("warc-record-id"), f.get("warc-type"), number(f.get("x-key")), (f.get("warc-payload-digest") or "").removeprefix("sha1:"), number(f.get("x-refers-to-key")), f.get("warc-segment-origin-id"), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), block))
                for i in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out[i : i + 256]], t) for c, t in enumerate(types)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, "id string, type string, key long, digest string, refers_to long, origin string, number long, total long, block binary")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, payload, problem = [], [], []
        for parts, digest in zip(batch.column("parts").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            body, why = None, None
            parts = sorted(parts, key=lambda p: p["number"])
            block = b"".join(p["block"] for p in parts)
            totals = [p["total"] for p in parts if p["total"] is not None]
            if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
                why = "segments are missing"
            elif (len(parts) > 1 or totals) and totals != [len(block)]:
                why = "the total length differs"
            else:
                head, _, body = block.partition(b"\r\n\r\n")
                try:
                    if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head):
                        body = unchunked(body)
                    if digest and sha1_base32(body) != digest:
                        raise ValueError("the digest differs")
                except ValueError as e:
                    body, why = None, str(e)
            size.append(None if body is None else len(body))
            payload.append(body)
            problem.append(why)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), batch.column("digest"), pa.array(size, pa.int64()), pa.array(payload, pa.binary()), pa.array(problem, pa.string())], names=["id", "key", "digest", "size", "payload", "problem"])


def reassemble(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """(id, key, digest, size, payload, problem) of every response, its continuations put together."""
    part = F.struct(F.coalesce("number", F.lit(1)).alias("number"), "total", "block")
    single = records.filter("type = 'response' and number is null").select("id", "key", "digest", F.array(part).alias("parts"))
    cut = records.filter("type in ('response', 'continuation') and number is not null")
    grouped = cut.groupBy(F.coalesce("origin", "id").alias("id")).agg(F.max("key").alias("key"), F.max("digest").alias("digest"), F.collect_list(part).alias("parts"))
    out = single.unionByName(grouped).mapInArrow(_decoded, "id string, key long, digest string, size long, payload binary, problem string")
    return out if keep_payload else out.drop("payload")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Per archived row: page_id, payload_bytes, payload_digest, record_type, refers_to, problem."""
    records = read_warc(spark, path)
    # written without payloads: two results read them, and the archives are not read again for the second
    responses = materialise(reassemble(records, keep_payload=False), "responses")
    own = responses.select(F.col("key").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    sizes = responses.groupBy("key", "digest").agg(F.max("size").alias("size")).select(F.col("key").alias("k"), F.col("digest").alias("d"), "size")
    sizes = materialise(sizes, "sizes")  # written, so that the join can deal out a response with very many revisits
    revisits = records.filter("type = 'revisit'").select("key", "digest", "refers_to")
    again = revisits.join(sizes, (F.col("refers_to") == F.col("k")) & (F.col("digest") == F.col("d")), "left")
    again = again.select(F.col("key").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", F.when(F.col("size").isNull(), "the response is missing").alias("problem"))
    return own.unionByName(again)


def archive_round_trip(df: DataFrame, **options) -> DataFrame:
    """Writes df as archives to the shared folder and returns what read_payloads() finds in them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    until_exit(spark, path)
    write_warc(df, path, **options)
    return read_payloads(spark, path)
