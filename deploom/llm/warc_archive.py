"""Content-addressed WARC archive.

Payload bytes are stored once, under a strong digest that is computed again from the bytes when they are read back. Each record's
exact header block is kept separately. A join of headers with payloads by digest gives back the original records, byte for byte; what is
reported of a record is parsed from these bytes.

Layout below one folder:  payloads/  WARC 1.1 files with one resource record for each distinct payload;
                          headers/   Parquet: page_id, digest and the exact WARC and HTTP header bytes of each record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, materialize, slices, small, table, text_of, work_dir

#: Bytes of an archive file before compression, about (a longer record has a file of its own), so that a reader's task holds a bounded file.
FILE_BYTES = 32 << 20
END_TEXT = "\r\n\r\n"
END = END_TEXT.encode()


def payload_head(sha256: str, sha1: str, size: int) -> str:
    return (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:{sha256}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: urn:sha256:{sha256}\r\n"
        f"WARC-Payload-Digest: sha1:{sha1}\r\nContent-Type: application/octet-stream\r\nContent-Length: {size}\r\n\r\n"
    )


def page_urn(page_id) -> str:
    """The id as part of a URN: characters that a header can't hold, and the per cent sign, are written by their bytes."""
    return quote(str(page_id), safe="")


def record_head(page_id, url: str, sha1: str, kind: str, refers_to, size: int) -> bytes:
    """WARC and HTTP header blocks of a capture; a revisit's block has the HTTP headers alone."""
    target = "".join(c for c in (url or "urn:none") if c not in "\r\n")
    page_id, refers_to = page_urn(page_id), page_urn(refers_to)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    more = f"WARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" if kind == "revisit" else ""
    length = len(http) + (size if kind == "response" else 0)
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Payload-Digest: sha1:{sha1}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {length}\r\n\r\n"
    )
    return head.encode() + http


def parse_records(data: bytes):
    """(headers, block) for each record of a WARC file's bytes; block is a view. Raises ValueError on a malformed record."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        block = view[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != END:
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, block
        at = end + 8 + size


def b32_sha1(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32_of_hex(sha1):
    """Base32 of 40 hex digits, as a column."""
    parts = [F.lpad(F.conv(F.substring(sha1, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, path: str, min_revisit: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes the archive of pages (page_id, url, html) below path.

    Of records with equal payloads of at least min_revisit bytes, the one with the smallest page_id is a response and the others are
    revisits of it. Null html: an empty payload. Null url: urn:none. Null page_ids are preferred last; a group of only null ids is
    all responses. Rows that repeat the smallest page_id are all responses. Columns besides the three are ignored.
    Ids may be any text: headers hold them with bytes other than letters, digits and `_.-~` as %XX, and reading undoes it.
    """
    data = F.encode(text_of(pages, "html"), "utf-8")
    rows = pages.select("page_id", text_of(pages, "html").alias("html"), F.sha2(data, 256).alias("digest"))
    # Groups are made of digests alone: payloads do not move here, and a hot payload is combined before the shuffle.
    facts = pages.select("page_id", "url", F.sha2(data, 256).alias("digest"), base32_of_hex(F.sha1(data)).alias("sha1"), F.length(data).cast("long").alias("size"))
    facts = materialize(facts, "warc-facts")
    # Written, so that the join's side is a table, which a hot digest's rows are dealt over.
    first = materialize(facts.groupBy("digest").agg(F.min("page_id").alias("first_id")), "warc-first")
    revisit = (F.col("size") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    joined = facts.join(small(first, 100), "digest").withColumn("revisit", revisit)
    id_type = dict(pages.dtypes)["page_id"]

    def blocks(batches):
        for batch in batches:
            c = batch.to_pydict()
            facts_of = zip(c["page_id"], c["url"], c["sha1"], c["revisit"], c["first_id"], c["size"], strict=True)
            head = [record_head(p, u, s, "revisit" if r else "response", f, n) for p, u, s, r, f, n in facts_of]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(head, pa.binary())], ["page_id", "digest", "head"])

    shown = joined.select("page_id", "digest", "url", "sha1", "revisit", "first_id", "size")
    shown.mapInArrow(blocks, f"page_id {id_type}, digest string, head binary").write.parquet(f"{path}/headers")
    # One copy of each payload. If the rows behind the first of their digest are few, they are left out where they are, and digests of which
    # several rows could be first (repeated rows, null ids) are cut to one row by a shuffle of their own; else all payloads move once.
    behind = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    later = materialize(joined.where(behind).select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest")), "warc-later")
    unclear = materialize(joined.where(~behind).groupBy("digest").count().where("count > 1").select("digest"), "warc-unclear")
    n_later, n_unclear = later.count(), unclear.count()
    if max(n_later, n_unclear) * 100 <= BROADCAST_BYTES:
        clear = rows.join(F.broadcast(later), rows["page_id"].eqNullSafe(later["later_id"]) & (rows["digest"] == later["later_digest"]), "left_anti")
        rest = clear.join(F.broadcast(unclear), "digest", "left_semi").dropDuplicates(["digest"])
        many = clear.join(F.broadcast(unclear), "digest", "left_anti").select("digest", "html").union(rest.select("digest", "html"))
    else:
        many = rows.dropDuplicates(["digest"]).select("digest", "html")

    def records(batches):
        held, size = [], 0
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                data = text.encode()
                held.append(payload_head(digest, b32_sha1(data), len(data)) + text)
                size += len(data) + 400
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END_TEXT.join(held)], pa.string())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END_TEXT.join(held)], pa.string())], ["value"])

    # A row is a file's records.
    many.mapInArrow(records, "value string").write.option("lineSep", END_TEXT).option("maxRecordsPerFile", 1).option("compression", "gzip").text(f"{path}/payloads")
    discard(pages.sparkSession, facts, first, later, unclear)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of the stored payloads, each digest computed again from the bytes; a mismatch raises."""

    def parse(batches):
        import zlib

        for batch in batches:
            for content in batch.column(0):
                digests, payloads, size = [], [], 0
                for headers, block in parse_records(zlib.decompress(content.as_py(), 31)):
                    digest = hashlib.sha256(block).hexdigest()
                    if headers["WARC-Record-ID"] != f"<urn:sha256:{digest}>":
                        raise ValueError(f"payload {headers['WARC-Record-ID']} does not match its digest")
                    digests.append(digest)
                    payloads.append(bytes(block))
                    size += len(block)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(payloads, pa.binary())], ["digest", "payload"])
                        digests, payloads, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(payloads, pa.binary())], ["digest", "payload"])

    files = spark.read.format("binaryFile").load(f"{path}/payloads").select("content")
    return files.mapInArrow(parse, "digest string, payload binary")


def rebuilt(head: bytes, payload: bytes) -> tuple[bytes, dict[str, str]]:
    """The record's bytes, put together from its header block and payload, and its WARC headers as parsed from them.

    Raises ValueError where the record does not parse, its lengths are not those of its bytes, or its digest is not that of the payload.
    """
    kind = head[: head.index(END)].decode().split("\r\n")
    record = head + (payload if "WARC-Type: response" in kind else b"") + END
    ((headers, block),) = parse_records(record)
    http = bytes(block[: len(head)]).split(END, 1)[0].decode().split("\r\n")
    if f"Content-Length: {len(payload)}" not in http or headers["WARC-Payload-Digest"] != f"sha1:{b32_sha1(payload)}":
        raise ValueError(f"record {headers['WARC-Record-ID']} does not fit its payload")
    return record, headers


def read_records(spark: SparkSession, path: str, with_bytes: bool = True) -> DataFrame:
    """Each archived record by joining headers with payloads: page_id, record_type, refers_to (the id named in the header, as text),
    payload_bytes, payload_digest, and, unless with_bytes is off, the record's original bytes."""
    headers = spark.read.parquet(f"{path}/headers")
    kind = dict(headers.dtypes)["page_id"]
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["record"] * with_bytes

    def rebuild(batches):
        for batch in slices(batches, 200):
            out = []
            for head, payload in zip(batch.column(1), batch.column(2), strict=True):
                payload = payload.as_py()
                record, found = rebuilt(head.as_py(), payload)
                refers = found.get("WARC-Refers-To")
                row = (found["WARC-Type"], refers and unquote(refers.removeprefix("<urn:page:").removesuffix(">")), len(payload), found["WARC-Payload-Digest"].removeprefix("sha1:"))
                out.append((*row, record) if with_bytes else row)
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names) - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(types)]], names)

    joined = headers.join(read_payloads(spark, path), "digest").select("page_id", "head", "payload")
    schema = f"page_id {kind}, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", record binary" * with_bytes
    return joined.mapInArrow(rebuild, schema)


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{work_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_records(spark, path, with_bytes=False).withColumn("refers_to", F.col("refers_to").cast(dict(pages.dtypes)["page_id"]))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     f AS (SELECT payload, min(page_id) AS first_id, sha1(payload) AS h FROM p GROUP BY payload),
     d AS (SELECT payload, first_id, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
       1 + ((('0x' || substr(h, (1 + 10 * (i // 8))::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31), 1)), 'string_agg', '') AS digest FROM f)
SELECT p.page_id, octet_length(p.payload) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN p.page_id = d.first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> d.first_id THEN d.first_id END AS refers_to
FROM p JOIN d ON p.payload = d.payload
"""
