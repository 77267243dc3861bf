"""Archives: roles, digests, exact round trip, tampering."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from shellgauge.llm import warc
from shellgauge.session import scratch

ROWS = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", "other é"), (4, None, None), (5, "x\r\nInjected: y", ""),
    (6, "http://d/", "same"), (6, "http://d/", "same"), (None, "http://e/", "same"), (None, "http://f/", "lonely"), (7, "u", "z" * 200_000),
]


def archive(spark, rows, **options):
    at = scratch(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("header", F.lit(1)).withColumn("sha256", F.lit("x"))
    warc.write_archive(df, at, **options)
    return at


def test_fields(spark):
    at = archive(spark, ROWS)
    got = sorted((str(r["key"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_headers(spark, at).collect())
    want = []
    for key, _, html in ROWS:
        body = (html or "").encode()
        top = max((k for k, _, h in ROWS if (h or "") == (html or "") and k is not None), default=None)
        first = top is None or key == top
        want.append((str(key), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2]))


def test_records_and_payloads(spark):
    at = archive(spark, ROWS)
    rows = warc.read_records(spark, at).collect()
    assert sorted(bytes(r["payload"]) for r in rows) == sorted((h or "").encode() for _, _, h in ROWS)
    for r in rows:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        body = b"" if fields[b"WARC-Type"] == b"revisit" else bytes(r["payload"])
        assert rest == body + b"\r\n\r\n" and int(fields[b"Content-Length"]) == len(body)
    stored = spark.read.parquet(f"{at}/payloads")
    assert stored.count() == stored.select("sha256").distinct().count() == len({h or "" for _, _, h in ROWS})


def test_least_bytes(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    at = archive(spark, rows, least_bytes=4)
    assert {r["key"]: (r["record_type"], r["refers_to"]) for r in warc.read_headers(spark, at).collect()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None),
    }


def test_urls_cannot_speak_for_the_record(spark):
    """Line ends of any kind, and whole fields, in URLs and keys."""
    urls = [
        f"http://b/{end}{field}" for end in ("\u0085", "\u2028", "\u2029", "\r\n", "\n", "\r", "\x0b", "\x00")
        for field in ("WARC-Refers-To: <urn:record:77>", "WARC-Payload-Digest: sha1:ABC", "WARC-Type: revisit")
    ] + ["", None, "http://a/%0A+%2B?q=a b", "é\u2028 +%", "X-Target-URI-Encoding: percent"]
    rows = [(i, u, "same" if i % 2 else f"own {i}") for i, u in enumerate(urls)]
    got = {r["key"]: r for r in warc.read_headers(spark, archive(spark, rows)).collect()}
    top = max(i for i, _, h in rows if h == "same")
    for i, u, h in rows:
        assert got[i]["uri"] == u and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", top) if h == "same" and i != top else ("response", None))
    at = scratch(spark, "warc-test")
    keys = ["a\r\nWARC-Type: revisit", "b>\u2028", "c d"]
    warc.write_archive(spark.createDataFrame([(k, "u", "x") for k in keys], "page_id string, url string, html string"), at)
    back = {r["key"]: (r["record_type"], r["refers_to"]) for r in warc.read_headers(spark, at, "string").collect()}
    assert back == {k: ("response", None) if k == max(keys) else ("revisit", max(keys)) for k in keys}


def test_tampered_payload_fails(spark):
    at = archive(spark, ROWS)
    bad = scratch(spark, "warc-test")
    spark.read.parquet(f"{at}/headers").write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{at}/payloads").withColumn("body", F.concat("body", F.lit(b"!"))).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="payload differs from its digest"):
        warc.read_headers(spark, bad).collect()


def test_empty(spark):
    at = archive(spark, [])
    assert warc.read_headers(spark, at).collect() == []
