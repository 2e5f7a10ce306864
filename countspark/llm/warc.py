"""Web archives: writing pages as WARC records, reading archives, and assembling the records of a capture.

A capture is a response (or a revisit of one with an equal payload), its request and its metadata. The records are separate and name
each other by ``WARC-Concurrent-To``; ``captures`` joins them and gives one nested row per response or revisit, ``loose_records`` gives the rest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from countspark.llm.components import components
from countspark.session import keep, keep_measured, new_path

#: Fixed values of the format.
CRLF = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource")
#: Records of one archive file at most; a reading task holds a compressed file, one record and a batch.
FILE_RECORDS = 12_000
#: Rows of repeated captures that one task puts out.
COPIES = 10_000
#: Records and bytes of content after which a batch is passed on.
BATCH_ROWS, BATCH_BYTES = 4_096, 16 << 20
RECORD = ("record_id string, type string, uri string, concurrent_to array<string>, refers_to string, payload_bytes bigint, payload_digest string, "
          "stated_digest string, content binary")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str) -> Column:
    name = F.md5(F.concat_ws("|", F.lit(kind), F.col("page_id").cast("string"), F.col("uri"), F.col("digest")).cast("binary"))
    cut = [F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text, without the two line ends behind it; a header without a value is left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), *[F.concat(F.lit(f"{n}: "), v) for n, v in headers],
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_pages(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, compression: str = "gzip") -> None:
    """Write ``pages`` (page_id, url, html) as archives: a request, a response or revisit, and a metadata record per row.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id (then url) is the response and the
    others revisit it; smaller payloads are all responses. A null html is an empty payload, a null url an empty one; control characters
    and blanks of a url are percent-coded. Repeated rows of the chosen page are responses as well. A null page_id is smaller than any other.
    """
    base = pages.select("page_id", F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\x00-\\x20\\x7f]", "%20").alias("uri"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", base32_sha1(F.col("payload")))
    same = base.where(F.octet_length("payload") >= least_bytes).groupBy(F.col("digest").alias("of")).agg(
        F.max(F.struct("page_id", "uri")).alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = base.join(same, F.col("digest") == F.col("of"), "left")
    first = F.col("chosen").isNull() | (F.col("page_id").eqNullSafe(F.col("chosen.page_id")) & (F.col("uri") == F.col("chosen.uri")))
    rows = rows.withColumn("first", first).withColumn("id", _record_id("response"))
    rows = rows.withColumn("refers", F.when(~F.col("first"), F.transform(F.array(F.struct(F.col("chosen.page_id").alias("page_id"), F.col("chosen.uri").alias("uri"))), lambda c: F.concat(
        F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", F.lit("response"), c["page_id"].cast("string"), c["uri"], F.col("digest")).cast("binary")),
                                              "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")))[0]))
    length = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF))
    uri = ("WARC-Target-URI", F.when(F.col("uri") != "", F.col("uri")))
    when = ("WARC-Date", F.lit(date))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    together = ("WARC-Concurrent-To", F.col("id"))
    request = _record(F.lit("request"), [("WARC-Record-ID", _record_id("request")), when, uri, together, ("Content-Type", F.lit("application/http;msgtype=request"))],
                      F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    response = _record(F.when(F.col("first"), "response").otherwise("revisit"),
                       [("WARC-Record-ID", F.col("id")), when, uri, digest, ("WARC-Refers-To", F.col("refers")),
                        ("WARC-Profile", F.when(~F.col("first"), REVISIT_PROFILE)), ("Content-Type", F.lit("application/http;msgtype=response"))],
                       F.concat(http, F.when(F.col("first"), F.col("payload")).otherwise(F.lit(""))))
    metadata = _record(F.lit("metadata"), [("WARC-Record-ID", _record_id("metadata")), when, uri, together, ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("fetched-by: batch"), F.coalesce(F.concat(F.lit(f"{CRLF}page-id: "), F.col("page_id").cast("string")), F.lit("")), F.lit(CRLF)))
    # every record ends with two line ends, which the text writer puts behind each row
    rows.select(F.explode(F.array(request, response, metadata)).alias("value")).write.option("lineSep", CRLF + CRLF).option(
        "compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _parse(file: BinaryIO) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (names in lower case) and content of each record; one record is held at a time."""
    while line := file.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers: dict[str, list[str]] = {}
        while (line := file.readline()) != b"\r\n":
            if not line.endswith(b"\r\n"):
                raise ValueError("a record is cut off in its head")
            name, _, value = line.partition(b":")
            headers.setdefault(name.strip().lower().decode(), []).append(value.strip().decode())
        size = int(headers["content-length"][0])
        content = file.read(size)
        if len(content) < size:
            raise ValueError("a record is cut off in its content")
        yield headers, content


def _row(headers: dict[str, list[str]], content: bytes, bodies: bool) -> tuple:
    one = lambda name: headers.get(name, [None])[0]
    kind = one("warc-type")
    payload = content.partition(b"\r\n\r\n")[2] if (one("content-type") or "").startswith("application/http") else content
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    stated = one("warc-payload-digest")
    return (one("warc-record-id"), kind, one("warc-target-uri"), headers.get("warc-concurrent-to", []), one("warc-refers-to"), len(payload), digest,
            stated and stated.partition(":")[2], content if bodies or kind != "response" else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in RECORD.split(", ")])


def read_records(spark: SparkSession, path: str, *, bodies: bool = False) -> DataFrame:
    """The records below ``path``, see ``RECORD``. Digest and size are those of the payload (of http records: behind the http head).

    ``content`` is kept for records other than responses, with ``bodies`` for these as well. A file, compressed as a whole or by records, is read record by record by one
    task; only its compressed bytes are held whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = io.BytesIO(memoryview(batch.column(1)[i].as_buffer()))
                packed = data.read(2) == b"\x1f\x8b"
                data.seek(0)
                rows, held = [], 0
                for headers, content in _parse(gzip.GzipFile(fileobj=data) if packed else data):
                    rows.append(_row(headers, content, bodies))
                    held += len(rows[-1][-1] or b"")
                    if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def _members(records: DataFrame) -> DataFrame:
    """``(member, a)``: the records other than responses, revisits and resources that belong to the capture with the id ``a``, see ``captures``."""
    anchor = F.col("type").isin(*ANCHORS)
    names = records.select("record_id", anchor.alias("anchor"), F.explode("concurrent_to").alias("to"))
    anchors = records.where(anchor).select(F.col("record_id").alias("a")).distinct()
    others = records.where(~anchor).select(F.col("record_id").alias("o")).distinct()
    direct = names.where("not anchor").join(anchors, F.col("to") == F.col("a")).select(F.col("record_id").alias("member"), "a")
    back = names.where("anchor").join(others, F.col("to") == F.col("o")).select(F.col("o").alias("member"), F.col("record_id").alias("a"))
    first = direct.unionByName(back).distinct()
    between, seen = keep_measured(names.where("not anchor and to <> record_id").join(others, F.col("to") == F.col("o")).select(F.col("record_id").alias("a"), F.col("o").alias("b")))
    if seen["n"] == 0:
        return first
    first, roots = keep(first), keep(components(between))
    reached = first.join(roots, F.col("member") == F.col("node")).select("root", "a").distinct()
    return first.unionByName(roots.join(reached, "root").select(F.col("node").alias("member"), "a")).distinct()


def captures(records: DataFrame) -> DataFrame:
    """One nested row per different response, revisit or resource: its columns, ``content`` as far as it was read, ``copies`` (how often
    it is there), ``requests``, ``metadata`` (arrays of record id and content, each different one once) and ``others`` (records of any
    other type alike, with their type in front).

    A record belongs to a capture if one of the two is concurrent to the other, or if a chain of such links over any number of records
    that are not captures themselves leads from one to the other; it can belong to several captures, and without an id to none. These are
    given by ``loose_records``; captures without such records have empty arrays. Different responses of one record id are rows of their
    own, each with all the records concurrent to that id. ``records`` is a written table.
    """
    anchor = F.col("type").isin(*ANCHORS)
    parts = records.where(~anchor).select("record_id", "type", "content").join(_members(records), F.col("record_id") == F.col("member"))
    one = F.struct("record_id", "content")
    nested = parts.groupBy("a").agg(F.sort_array(F.collect_set(F.when(F.col("type") == "request", one))).alias("requests"),
                                    F.sort_array(F.collect_set(F.when(F.col("type") == "metadata", one))).alias("metadata"),
                                    F.sort_array(F.collect_set(F.when(~F.col("type").isin("request", "metadata"), F.struct("type", "record_id", "content")))).alias("others"))
    none = F.array().cast("array<struct<record_id:string,content:binary>>")
    each = records.where(anchor).groupBy("record_id", "type", "uri", "refers_to", "payload_bytes", "payload_digest", "stated_digest", "content").agg(F.count(F.lit(1)).alias("copies"))
    return each.join(nested, F.col("record_id") == F.col("a"), "left").withColumns(
        {"requests": F.coalesce("requests", none), "metadata": F.coalesce("metadata", none),
         "others": F.coalesce("others", F.array().cast("array<struct<type:string,record_id:string,content:binary>>"))}).drop("a")


def loose_records(records: DataFrame) -> DataFrame:
    """The records that belong to no capture, as they are and as often as they are there; ``captures`` has all others."""
    anchor = F.coalesce(F.col("type").isin(*ANCHORS), F.lit(False))
    return records.where(~anchor).join(_members(records).select("member").distinct(), F.col("record_id") == F.col("member"), "left_anti")


def _repeated(found: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says; many copies of one row are put out by several tasks. ``found`` is a written table."""
    pieces = found.where("copies > 1").withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES)))).repartition("record_id", "_from")
    many = pieces.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("_from"))))).drop("_from", "_i")
    return found.where("copies = 1").unionByName(many).drop("copies")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages as archives into the shared folder, read them back, and return a row per page: ``page_id``, ``payload_bytes``,
    ``payload_digest`` (both of the full payload), ``record_type``, ``refers_to`` (the page_id of the response that is revisited)."""
    spark = pages.sparkSession
    path = new_path(spark)
    write_pages(pages, path)
    found = captures(keep(read_records(spark, path)))
    page = F.regexp_extract(F.decode(F.col("metadata")[0]["content"], "UTF-8"), "page-id: ([^\\r\\n]+)", 1)
    found = keep(found.select("copies", "record_id", "type", "refers_to", "payload_bytes", "payload_digest", F.when(page != "", page).cast(pages.schema["page_id"].dataType).alias("page_id")))
    full = found.where("type = 'response'").select(F.col("record_id").alias("of"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    full = full.dropDuplicates(["of"])
    found = _repeated(found)
    # only revisits look for a response: rows without a reference would all meet in one task
    names = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type")]
    again = found.where("type = 'revisit'").join(full, F.col("refers_to") == F.col("of"), "left").select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("type").alias("record_type"), F.col("of_page").alias("refers_to"))
    return found.where("type <> 'revisit'").select(*names, F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to")).unionByName(again)
