"""WARC archives with revisit records.

Headers, not payloads, are shuffled by payload digest to find the record that keeps each payload. Archives are
WARC/1.1 files, gzipped whole: Spark's text writer ends every record with the two line breaks the format asks for, so
files come from Spark's committer and may lie in any store that Spark reaches.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import workspace

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 5000


def _record_id(page: Column, digest: Column) -> Column:
    """A URN made of the page and its payload, so that a repeated task writes the same identifiers."""
    h = F.md5(F.concat_ws(" ", F.coalesce(page.cast("string"), F.lit("")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null. Line breaks in a value are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def write_archives(
    pages: DataFrame, out: str, min_bytes: int = MIN_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip"
) -> None:
    """One record for each row of ``page_id, url, html`` in WARC files under ``out``.

    A null payload is empty. Of equal payloads of at least ``min_bytes`` bytes, that with the largest page_id is
    written as a response (a null page_id is less than any) and the others revisit it; rows equal in page_id and
    payload are the same capture and share a record. ``date`` is the capture time, which the table does not have.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    heads = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.sha1(payload).alias("digest"),
        F.sha2(payload, 256).alias("guard"),  # SHA-1 alone can be made to collide
        F.octet_length(payload).cast("long").alias("bytes"),
    ).filter(F.col("bytes") >= min_bytes)
    originals = heads.groupBy("digest", "guard").agg(
        F.max(F.struct("page_id", "url")).alias("original"), F.count(F.lit(1)).alias("captures")
    )
    revisits = (
        heads.join(workspace.materialise(originals.filter("captures > 1"), "originals"), ["digest", "guard"])
        .filter(~F.col("page_id").eqNullSafe(F.col("original.page_id")))
        .select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "original")
        .distinct()
    )
    joined = own.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("original").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(revisit, _record_id(F.col("original.page_id"), F.col("digest")))),
        _field("WARC-Refers-To-Target-URI", F.when(revisit, F.col("original.url"))),
        _field("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("X-Page-Id", F.col("page_id")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _field("Content-Length", block_bytes),
        F.lit(CRLF),
    )
    record = F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    (
        joined.select(record.alias("value"))
        .write.option("lineSep", CRLF + CRLF)
        .option("compression", compression)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(out)
    )


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of an archive, which is unpacked as it is read."""
    whole = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=whole) if data[:2] == b"\x1f\x8b" else whole, 1 << 18)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("the archive ends inside a header")
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("the archive ends inside a record")
        yield fields, block


def archive_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in records(content.as_py()):
                page = fields.get("x-page-id")
                row = {"page_id": int(page) if page else None, "record_type": fields["warc-type"], "record_id": fields["warc-record-id"], "refers": fields.get("warc-refers-to"), "named_digest": fields["warc-payload-digest"].partition(":")[2]}
                if row["record_type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, ARCHIVE_SCHEMA)


ARCHIVE_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers", pa.string()), ("named_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to. Revisits take both from their original."""
    files = spark.read.format("binaryFile").load(out).select("content")
    ddl = "page_id long, record_type string, record_id string, refers string, named_digest string, payload_bytes long, payload_digest string"
    rows = workspace.materialise(workspace.arrow_map(files, archive_rows, ddl), "records")
    responses = rows.filter("record_type = 'response'")
    originals = (
        responses.join(rows.filter("record_type = 'revisit'").select(F.col("refers").alias("record_id")).distinct(), "record_id", "left_semi")
        .groupBy("record_id")
        .agg(F.max("page_id").alias("o_page"), F.max("payload_bytes").alias("o_bytes"), F.max("payload_digest").alias("o_digest"))
    )
    originals = workspace.materialise(originals, "originals")
    resolved = (
        rows.filter("record_type = 'revisit'")
        .join(originals, F.col("refers") == originals["record_id"], "left")
        .select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), "record_type", F.col("o_page").alias("refers_to"))
    )
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(resolved)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back.

    A null payload is empty. Rows equal in page_id and payload are one capture (the response, twice); a null page_id is
    less than any. Payloads of any length are whole; a worker holds one record and a packed file. Other columns are not
    read. An empty table gives an empty result.
    """
    workspace.bounded_batches(spark)
    out = workspace.new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), out)
    return read_archives(spark, out)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
        CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS original FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to FROM q
"""
