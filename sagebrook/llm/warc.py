"""A content-addressed WARC archive.

An archive is two tables in one folder.  ``payloads`` holds the bytes of every distinct
payload once, compressed, under its SHA-256; ``records`` holds the exact header of every record (the WARC
header and the HTTP header of its block) and the digest of its payload.  ``restore`` joins
them to the original records and checks every payload against its digest.

Of records with equal payloads one is a ``response``, the others are ``revisit`` records
whose block has only the HTTP header, as WARC 1.1 has it.  ``write_files`` and ``read_files``
exchange records as plain .warc files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, discard, materialize, narrow, session_dir, table

#: Payloads under this many bytes are stored with every record's type left at response.
MIN_BYTES = 0
#: The capture date of records; a parameter, so that archives repeat.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

_FROM = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: The alphabet of base32.
_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexa: Column, digits: int = 40) -> Column:
    """Upper-case base32 of a hexadecimal digest whose length is a multiple of 5 digits."""
    parts = [F.lpad(F.conv(F.substring(hexa, i, 5), 16, 32), 4, "0") for i in range(1, digits, 5)]
    return F.translate(F.concat(*parts), _FROM, _TO)


def _urn(name: Column) -> Column:
    d = F.md5(name)
    cut = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _headers(date: str) -> Column:
    """The WARC header and HTTP header of a record, up to where its payload would stand."""
    kind = F.col("record_type")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    own = F.octet_length(http) + F.when(kind == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    # The row's number tells rows apart that are equal in all else.
    parts = ("page_id", "url", "sha256", "number")
    name = F.concat_ws("|", F.lit("page"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _urn(name)),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Refers-To-Page-ID", F.col("refers_to")),
        _line("WARC-Profile", F.when(kind == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        _line("Content-Length", own),
        F.lit(CRLF),
        http,
    )


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    packer = zstandard.ZstdCompressor(level=3)
    packed = pa.array([packer.compress(x.as_buffer()) for x in batch.column(2)], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["page_id", "sha256", "packed"])


def _unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
    out, unpacker = [], zstandard.ZstdDecompressor()
    for digest, packed in zip(batch.column(1), batch.column(2)):
        if not packed.is_valid:
            raise ValueError(f"the payload of {digest.as_py()} is missing")
        data = unpacker.decompress(packed.as_buffer())
        if hashlib.sha256(data).hexdigest() != digest.as_py():
            raise ValueError(f"the stored payload does not have its digest {digest.as_py()}")
        out.append(data)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(3)], names=["header", "payload", "url"])


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Archive ``pages`` (page_id, url, html) in the folder ``path``.

    A null page is an empty payload.  Rows that repeat a page_id and its payload are equal
    records, each with a Record-ID of its own; a null page_id is below every other.  A line break
    in a url, which no header can hold, is written as %0A there; the exact url is kept beside the
    header.  Further columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha256", F.sha2("payload", 256))
    known = materialize(
        rows.select(
            "page_id",
            "url",
            "sha256",
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            base32(F.sha1("payload")).alias("payload_digest"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "warc-known",
    )
    first = materialize(known.groupBy("sha256").agg(F.max("page_id").alias("first")), "warc-first")
    is_first = F.col("page_id").eqNullSafe(F.col("first")) | (F.col("payload_bytes") < min_bytes)
    records = (
        known.join(first, "sha256")
        .withColumn("record_type", F.when(is_first, F.lit("response")).otherwise(F.lit("revisit")))
        .withColumn("refers_to", F.when(~is_first, F.col("first")))
    )
    records.select(F.encode(_headers(date), "UTF-8").alias("header"), "sha256", "url").write.option("compression", "zstd").parquet(f"{path}/records")
    # Payloads travel compressed.  Copies are told by digest and page together, so those of
    # one payload are spread over all tasks; what is left holds a payload more than once only
    # where whole rows repeat.
    others = known.join(first, "sha256").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("sha256", "page_id").distinct()
    copies = materialize(others, "warc-copies")
    others = narrow(copies.select(F.col("sha256").alias("digest"), F.col("page_id").alias("copy")))
    packed = batched(rows.select("page_id", "sha256", "payload"), _pack, "page_id long, sha256 string, packed binary")
    is_copy = (F.col("sha256") == F.col("digest")) & F.col("page_id").eqNullSafe(F.col("copy"))
    stored = packed.join(others, is_copy, "left_anti").select("sha256", "packed")
    stored.dropDuplicates(["sha256"]).write.parquet(f"{path}/payloads")
    discard(known, first, copies)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, url) of every record of an archive, the url as it was given; a payload
    that does not have its digest, or is missing, is an error."""
    payloads = spark.read.schema("sha256 string, packed binary").parquet(f"{path}/payloads")
    records = spark.read.schema("header binary, sha256 string, url string").parquet(f"{path}/records")
    joined = records.join(payloads, "sha256", "left").select("header", "sha256", "packed", "url")
    return batched(joined, _unpack, "header binary, payload binary, url string")


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def parse(records: DataFrame) -> DataFrame:
    """What restored records say: one row per record, digest and size taken from the payload, the
    url from the header where it does not stand beside it."""
    text = F.decode("header", "UTF-8")
    url = F.col("url") if "url" in records.columns else _field(text, "WARC-Target-URI")
    return records.select(
        _field(text, "WARC-Page-ID").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
        _field(text, "WARC-Type").alias("record_type"),
        _field(text, "WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        _field(text, "WARC-Payload-Digest").alias("stated_digest"),
        url.alias("url"),
        _field(text, "WARC-Record-ID").alias("record_id"),
    )


def write_files(records: DataFrame, path: str) -> None:
    """Restored records (header, payload) as .warc files; a revisit's block has no payload.  A null
    payload is empty, records without a header are left out, and other columns are ignored; an
    empty table gives empty files."""
    header = F.decode("header", "UTF-8")
    is_response = _field(header, "WARC-Type") == "response"
    block = F.when(is_response, F.coalesce(F.decode("payload", "UTF-8"), F.lit(""))).otherwise(F.lit(""))
    rows = records.filter("header is not null").select(F.concat(header, block))
    rows.write.option("lineSep", CRLF + CRLF).text(path)


def _cut_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of the records of a file, one after the other."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", head)[1])
        block = data[end : end + size]
        if not head.startswith(b"WARC/") or len(block) < size:
            raise ValueError("no WARC record, or a short one")
        cut = block.index(b"\r\n\r\n") + 4
        yield head + block[:cut], block[cut:]
        at = end + size + 4


def _records(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for path, cell in zip(batch.column(0), batch.column(1)):
        rows, error = [], None
        try:
            for header, payload in _cut_records(cell.as_py()):
                rows.append((header, payload, None))
        except (ValueError, TypeError) as e:
            error = f"damaged after {len(rows)} records: {e}"
            rows.append((None, None, error))
        yield pa.RecordBatch.from_arrays(
            [pa.array([path.as_py()] * len(rows), pa.string())] + [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.string()))],
            names=["path", "header", "payload", "error"],
        )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, payload, error) of the records of .warc files.

    A file is read whole by one task, so it should be of the usual size of about 1 GB at most.
    Where a file is damaged, the records before the damage are followed by one row that has only
    the error; an empty file has no rows.
    """
    return batched(spark.read.format("binaryFile").load(path).select("path", "content"), _records, "path string, header binary, payload binary, error string")


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archive back, one row per page."""
    spark = pages.sparkSession
    path = f"{session_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, min_bytes)
    return parse(restore(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, archived and read back."""
    return round_trip(table(spark, sf_dir, "pages"))


def op5_sql(min_bytes: int = MIN_BYTES) -> str:
    parts = " || ".join(f"to_base(CAST('0x' || substr(h, {i}, 5) AS BIGINT), 32, 4)" for i in range(1, 40, 5))
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, translate({parts}, '{_FROM}', '{_TO}') AS payload_digest,
       CASE WHEN n < {min_bytes} OR page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= {min_bytes} AND page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM q"""
