"""Archives against the pages they were written from, links between records, odd rows."""

import base64
import gzip
import hashlib

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from countspark.llm import warc
from countspark.session import keep, new_path


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_pages(spark):
    bad = "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (9, "http://a/9", None), (4, None, ""), (5, "http://a b\r\nc", bad), (6, "u", bad), (7, "u", "x" * 3_000_000), (8, "u", "é\u0000\n"),
            (3, "http://a/3", "<p>é</p>"), (10, "v", "same"), (10, "w", "same"), (11, "z", "twice"), (11, "z", "twice"), (None, "n", "alone"), (None, "n", "same")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, uri string")
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
    for i, _, html in rows:
        assert any(x[:2] == (len((html or "").encode()), digest(html)) for x in by[i])
    kinds = {i: sorted((x[2], x[3] or 0) for x in v) for i, v in by.items()}
    assert kinds[1] == [("revisit", 3)] and kinds[2] == [("revisit", 3)] and kinds[3] == [("response", 0)]
    assert kinds[4] == [("revisit", 9)] and kinds[9] == [("response", 0)] and kinds[5] == [("revisit", 6)]
    assert kinds[10] == [("response", 0), ("revisit", 10)] and kinds[11] == [("response", 0)] * 2
    assert kinds[None] == [("response", 0), ("revisit", 10)]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_repeated_rows_and_long_pages(spark):
    same = spark.range(25_000).select(F.lit(3).cast("bigint").alias("page_id"), F.lit("u").alias("url"), F.lit("again").alias("html"))
    long = spark.range(40).select((F.col("id") + 100).alias("page_id"), F.lit("v").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("0123456789"), 100_000)).alias("html"))
    got = keep(warc.archive_pages(same.union(long).coalesce(1)))
    assert [tuple(r) for r in got.where("page_id = 3").groupBy(*got.columns).count().collect()] == [(3, 5, digest("again"), "response", None, 25_000)]
    assert {tuple(r) for r in got.where("page_id <> 3").collect()} == {(i + 100, len(f"{i}") + 1_000_000, digest(f"{i}" + "0123456789" * 100_000), "response", None) for i in range(40)}


def test_members(spark, tmp_path):
    """A file of one compressed member per record, as archives usually are, and a cut one."""
    record = lambda i: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: 7\r\n\r\nWARC/{i}\r\n\r\n".encode()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(10, 20)))
    got = warc.read_records(spark, str(tmp_path / "a.warc.gz")).select("record_id", "payload_bytes", F.col("content").cast("string").alias("c")).collect()
    assert {tuple(r) for r in got} == {(f"<{i}>", 7, f"WARC/{i}") for i in range(10, 20)}
    (tmp_path / "b.warc").write_bytes(record(10)[:-7])
    with pytest.raises(PythonException, match="cut off"):
        warc.read_records(spark, str(tmp_path / "b.warc")).collect()


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer"), (4, "d", "longer")], "page_id bigint, url string, html string")
    path = new_path(spark)
    warc.write_pages(pages, path, least_bytes=3, compression="none")
    assert sorted(r["type"] for r in warc.read_records(spark, path).where("type like 're%' and type <> 'request'").collect()) == ["response", "response", "response", "revisit"]


def test_links(spark):
    rec = lambda i, kind, to: (i, kind, "u", to, None, 0, "d", None, b"c")
    rows = [rec("r1", "response", []), rec("q1", "request", ["r1"]), rec("m1", "metadata", ["q1"]), rec("r2", "response", ["q2", "m2"]), rec("q2", "request", []), rec("m2", "metadata", ["r2"]),
            rec("m3", "metadata", ["gone"]), rec("r3", "revisit", []), rec("i", "warcinfo", [])]
    got = {r["record_id"]: ([x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]]) for r in warc.captures(keep(spark.createDataFrame(rows, warc.RECORD))).collect()}
    assert got == {"r1": (["q1"], ["m1"]), "r2": (["q2"], ["m2"]), "r3": ([], [])}


def test_every_record_is_given(spark):
    """Chains of links, records of two captures, other types and contents; what belongs to no capture is given as it is."""
    rec = lambda i, kind, to: (i, kind, "u", to, None, 0, "d", None, i and i.encode())
    rows = [rec("r1", "response", []), rec("c0", "request", ["r1"]), *[rec(f"c{k}", "metadata", [f"c{k - 1}"]) for k in range(1, 8)], rec("c8", "metadata", []), rec("c9", "request", ["c8", "c7"]),
            rec("r2", "resource", []), rec("q2", "request", ["r2"]), rec("both", "metadata", ["r3", "q2"]), rec("r3", "revisit", ["v3"]), rec("v3", "conversion", ["v3"]), rec("r4", "response", ["r3"]),
            rec("i", "warcinfo", []), rec("m", "metadata", ["gone"]), rec("n", "metadata", ["m"]), rec("n", "metadata", ["m"]), rec(None, "request", ["m"]), rec(None, "request", ["r4"])]
    records = keep(spark.createDataFrame(rows, warc.RECORD))
    got = {r["record_id"]: r for r in warc.captures(records).collect()}
    ids = lambda i, kind: [x["record_id"] for x in got[i][kind]]
    assert set(got) == {"r1", "r2", "r3", "r4"}
    assert ids("r1", "requests") == ["c0", "c9"] and ids("r1", "metadata") == [f"c{k}" for k in range(1, 9)]
    assert ids("r2", "requests") == ["q2"] == ids("r3", "requests") and ids("r2", "metadata") == ["both"] == ids("r3", "metadata")
    assert [tuple(x) for x in got["r3"]["others"]] == [("conversion", "v3", b"v3")] and got["r2"]["content"] == b"r2" and ids("r2", "others") == []
    assert ids("r4", "requests") == ids("r4", "metadata") == ids("r4", "others") == []
    assert sorted(r["record_id"] or "" for r in warc.loose_records(records).collect()) == ["", "", "i", "m", "n", "n"]
    assert warc.loose_records(keep(records.limit(0))).count() == 0
    # http heads and bodies
    path = new_path(spark)
    warc.write_pages(spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy")], "page_id bigint, url string, html string"), path)
    got = {r["type"]: r["content"].partition(b"\r\n\r\n")[2] for r in warc.captures(keep(warc.read_records(spark, path, bodies=True))).collect()}
    assert got == {"response": b"xy", "revisit": b""}


def test_base32(spark):
    values = ["", "a", "é", "x" * 1000]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", warc.base32_sha1(F.col("v")).alias("d")).collect()
    assert all(r["d"] == digest(r["v"]) for r in rows)
