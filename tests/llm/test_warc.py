"""The archive: records against plain Python, bytes stored once, damage noticed."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import warc
from tessella.llm.common import new_folder

BODY = "<p>the same page again and again</p>" * 5
ROWS = [
    (5, "http://a.example/1", BODY), (3, "http://a.example/2", BODY), (9, None, BODY), (4, "http://b.example/\r\nX-Evil: 1", "short"), (6, "http://b.example/2", "short"),
    (7, "http://c.example/", None), (8, "", ""), (10, "http://d.example/ü 日本", "Ünï 日本 😀\r\n\r\n" * 20), (None, "http://e.example/", BODY), (None, "http://f.example/", "alone" * 30),
    (12, "http://g.example/", "twice" * 30), (12, "http://g.example/", "twice" * 30), (13, "http://g.example/", "twice" * 30), (14, "http://h.example/", "x" * 99), (15, "http://h.example/", "x" * 99),
    (16, "http://h.example/", "y" * 100), (17, "http://h.example/", "y" * 100), (18, "http://long.example/", "lorem ipsum " * 200_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "z") for r in ROWS], "page_id long, url string, html string, digest int, head string")


@pytest.fixture(scope="module")
def archive(spark, pages):
    path = new_folder(spark, "archive")
    warc.write(pages, path)
    return path


def expected(page_id, url, html):
    payload = (html or "").encode()
    ids = [i for i, _, h in ROWS if (h or "").encode() == payload and i is not None]
    first = min(ids, default=None)
    revisit = len(payload) >= 100 and page_id != first
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A")] * (url is not None)
    lines += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}"]
    lines += [f"WARC-Profile: {warc.PROFILE}", f"WARC-Refers-To: {name(first)}"] * revisit
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_come_back_byte_for_byte(spark, archive):
    found = sorted(bytes(r["record"]) for r in warc.records(spark, archive).select("record").collect())
    assert found == sorted(expected(*r) for r in ROWS)


def test_fields(spark, archive):
    rows = warc.parsed(warc.records(spark, archive)).withColumn("page_id", warc.page_of("record_id")).withColumn("first", warc.page_of("refers_to")).collect()
    for r in rows:
        assert hashlib.sha256(r["payload"]).hexdigest() == r["digest"]
        assert bytes(r["body"]) == (b"" if r["record_type"] == "revisit" else bytes(r["payload"]))
    found = sorted((r["page_id"] or -1, r["record_type"], r["first"] or -1) for r in rows)
    assert (5, "revisit", 3) in found and (3, "response", -1) in found and (-1, "revisit", 3) in found and (-1, "response", -1) in found
    assert found.count((12, "response", -1)) == 2 and (13, "revisit", 12) in found
    assert (15, "response", -1) in found and (17, "revisit", 16) in found and len(found) == len(ROWS)


def test_payloads_are_stored_once(spark, archive):
    stored = spark.read.parquet(f"{archive}/payloads")
    assert stored.count() == len({h or "" for _, _, h in ROWS}) == stored.select("digest").distinct().count()


def test_damage_is_noticed(spark, archive):
    path = new_folder(spark, "damaged")
    spark.read.parquet(f"{archive}/headers").write.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{archive}/payloads")
    stored.withColumn("payload", F.when(F.length("payload") == 100, F.lit(b"z" * 100)).otherwise(F.col("payload"))).write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.records(spark, path).collect()
    gone = new_folder(spark, "gone")
    spark.read.parquet(f"{archive}/headers").write.parquet(f"{gone}/headers")
    stored.where("size <> 100").write.parquet(f"{gone}/payloads")
    with pytest.raises(Exception, match="a payload is missing"):
        warc.records(spark, gone).collect()


def test_empty(spark, pages):
    path = new_folder(spark, "nothing")
    warc.write(pages.limit(0), path)
    assert warc.parsed(warc.records(spark, path)).count() == 0
