"""Content-addressed WARC archive: payload bytes once by strong digest, exact record headers apart, records by a join.

A folder of an archive holds two tables. ``payloads`` has one row for each distinct payload under its SHA-256;
``headers`` has one row for each record with its exact WARC header, the exact HTTP head of a response's block, and the
digest of the payload that follows it. A record is header + block + CRLF CRLF, as WARC/1.1 has it: every record has its
own id and a date, a response's block is an HTTP message with the payload as its body, and a revisit has an empty block
and names the response that it repeats. The records' bytes, one after another, are a WARC file.

Defined cases: a null payload is empty; of records with equal payloads the one with the smallest id is the response
(null ids count as largest, and of rows repeated in full one is the response); payloads shorter than
``min_revisit_bytes`` are always responses; a payload of any length is one value of a row; line breaks in a target are
blanks; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload):
    """Column: upper-case base32 of the SHA-1, eight times five hex digits to four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uri(archive: str, uid):
    """Column: an id for the row of this archive, a UUID of the name-based kind."""
    h = F.md5(F.concat_ws("/", F.lit(archive), uid.cast("string")))
    cut = lambda a, n: F.substring(h, a + 1, n)
    return F.concat(F.lit("<urn:uuid:"), cut(0, 8), F.lit("-"), cut(8, 4), F.lit("-3"), cut(13, 3), F.lit("-8"), cut(17, 3), F.lit("-"), cut(20, 12), F.lit(">"))


def http_head(n_bytes):
    """Column: the HTTP head of a payload of so many bytes."""
    return F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n_bytes.cast("string"), F.lit("\r\n\r\n")), "UTF-8")


def header_bytes(archive: str, date: str):
    """Column: the header of a record, from columns id, uid, target, n_bytes, sha1, block_sha1, record_type, refers_to and refers_uid."""
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    revisit = F.col("record_type") == "revisit"
    clean = F.regexp_replace(F.coalesce(F.col("target"), F.lit("")), r"[\r\n]+", " ")
    optional = lambda name, value: F.coalesce(line(name, value.cast("string")), F.lit(""))
    text = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_uri(archive, F.col("uid"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_uri(archive, F.col("refers_uid"))), line("WARC-Refers-To-Date", F.lit(date)), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.col("block_sha1")))),
        optional("X-Page-ID", F.col("id")),
        F.when(revisit, optional("X-Refers-To-Page-ID", F.col("refers_to"))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise((F.octet_length(http_head(F.col("n_bytes"))) + F.col("n_bytes")).cast("string"))),
        F.lit("\r\n\r\n"),
    )
    return F.encode(text, "UTF-8")


def write_archive(spark: SparkSession, pages: DataFrame, folder: str, *, key: str = "page_id", payload: str = "html", target: str = "url", min_revisit_bytes: int = 0, date: str | None = None) -> None:
    """Writes the two tables of an archive into folder; date: of all records, now if it is not given."""
    scratch, archive = Scratch(spark, "warc"), uuid.uuid4().hex
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(target).cast("string").alias("target"), body.alias("payload"))
    (
        rows.select(F.sha2("payload", 256).alias("sha256"), "payload")
        .groupBy("sha256")
        .agg(F.first("payload").alias("payload"))
        .write.option("compression", "zstd")
        .parquet(f"{folder}/payloads")
    )
    light = rows.select("id", "target", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"), base32_sha1(F.concat(http_head(F.octet_length("payload")), "payload")).alias("block_sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    light = scratch.write(light.withColumn("uid", F.monotonically_increasing_id()), "light")
    repeated = F.col("n_bytes") >= min_revisit_bytes
    order = F.struct(F.col("id").isNull().alias("last"), "id", "uid")
    first = light.filter(repeated).groupBy("sha256").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha256", "first")
    typed = light.join(first, "sha256", "left").select(
        "id", "uid", "target", "n_bytes", "sha1", "block_sha1", "sha256",
        F.when(repeated & (F.col("first.uid") != F.col("uid")), "revisit").otherwise("response").alias("record_type"),
        F.col("first.id").alias("refers_to"), F.col("first.uid").alias("refers_uid"),
    )
    response = F.col("record_type") == "response"
    typed.select(header_bytes(archive, date).alias("header"), F.when(response, http_head(F.col("n_bytes"))).alias("http"), F.when(response, F.col("sha256")).alias("sha256")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Reconstructs the records: record (all its bytes), and sha256, the digest that its payload is stored under (null for a revisit)."""
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    end = F.lit(b"\r\n\r\n")
    response = headers.filter("sha256 is not null").join(payloads, "sha256", "left")  # a payload that is lost leaves a null record
    response = response.select("sha256", F.concat("header", "http", "payload", end).alias("record"))
    return response.unionByName(headers.filter("sha256 is null").select("sha256", F.concat("header", end).alias("record")))


def parse_record(raw: bytes | memoryview) -> tuple[dict[str, str], memoryview]:
    """Header fields and block of one record; its form and lengths are checked."""
    view = memoryview(raw)
    size = 4096
    while (cut := bytes(view[:size]).find(b"\r\n\r\n")) < 0:
        if size >= len(view):
            raise ValueError("a record without an end of its header")
        size *= 4
    first, *lines = bytes(view[:cut]).decode("utf-8").split("\r\n")
    if first != VERSION:
        raise ValueError(f"not a record header: {first[:40]!r}")
    fields, block = dict(x.split(": ", 1) for x in lines), view[cut + 4 : -4]
    if bytes(view[-4:]) != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError(f"{fields['WARC-Record-ID']}: block of {len(block)} bytes, not {fields['Content-Length']}")
    return fields, block


def base32(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def described(fields: dict[str, str], block: memoryview, sha256: str | None) -> tuple:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of a record whose digests hold."""
    number = lambda name: int(fields[name]) if name in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        payload = block[bytes(block[:4096]).index(b"\r\n\r\n") + 4 :]
        if len(payload) != number("X-Payload-Length") or base32(payload) != digest or f"sha1:{base32(block)}" != fields["WARC-Block-Digest"] or hashlib.sha256(payload).hexdigest() != sha256:
            raise ValueError(f"{fields['WARC-Record-ID']}: a digest does not match")
    return number("X-Page-ID"), number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page-ID")


def parsed(records: DataFrame) -> DataFrame:
    """Parses reconstructed records and verifies lengths and digests: id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def parse(batches):
        for batch in batches:
            out = []
            for sha256, record in zip(batch["sha256"].to_pylist(), batch["record"], strict=True):
                if not record.is_valid:
                    raise ValueError(f"the payload {sha256} is missing")
                out.append(described(*parse_record(record.as_buffer()), sha256))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, schema.types, strict=True)], schema=schema)

    return records.select("sha256", "record").mapInArrow(parse, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes an archive of the pages into the shared folder, reads it back and describes every record."""
    folder = f"{Scratch(spark, 'warc-archive').path}"
    write_archive(spark, pages, folder)
    return parsed(read_records(spark, folder)).withColumnRenamed("id", "page_id")
