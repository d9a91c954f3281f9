"""Repeated headers, coded payloads, and what the query returns."""

import gzip
import json
import zlib

import pytest

pytest.importorskip("latticeflow.llm")
from latticeflow.llm import queries, warc  # noqa: E402

TEXT = "<p>café</p>".encode() * 50
BARE = zlib.compressobj(wbits=-15)
BARE_TEXT = BARE.compress(TEXT) + BARE.flush()


def chunked(data):
    return b"".join(b"%x;x=1\r\n%b\r\n" % (len(data[k : k + 7]), data[k : k + 7]) for k in range(0, len(data), 7)) + b"0\r\n\r\n"


@pytest.mark.parametrize(
    "head, payload",
    [
        ("", TEXT),
        ("Transfer-Encoding: chunked", chunked(TEXT)),
        ("Transfer-Encoding: chunked", TEXT),
        ("Content-Encoding: gzip", gzip.compress(TEXT)),
        ("Content-Encoding: gzip", TEXT),
        ("Content-Encoding: gzip", gzip.compress(TEXT[:60]) + gzip.compress(TEXT[60:])),
        ("Content-Encoding: deflate", zlib.compress(TEXT)),
        ("Content-Encoding: deflate", BARE_TEXT),
        ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked(gzip.compress(TEXT))),
    ],
)
def test_codings(head, payload):
    _, headers, raw = warc.http_parts(f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".replace("\r\n\r\n\r\n", "\r\n\r\n").encode() + payload)
    assert raw == payload and warc.decoded(raw, headers) == TEXT.decode()


def test_repeated_headers(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nVia: x\r\n\r\n<p>x</p>"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Concurrent-To: <urn:uuid:2>\r\nWARC-Concurrent-To: <urn:uuid:3>\r\nContent-Length: {len(block)}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(head.encode() + block + b"\r\n\r\n")
    rows = warc.derive(warc.read_responses(spark, f"file://{tmp_path}/a.warc")).where("record_type = 'metadata'").collect()
    held = json.loads(rows[0]["block"])["Envelope"]
    assert held["WARC-Header-Metadata"]["WARC-Concurrent-To"] == "<urn:uuid:2>, <urn:uuid:3>"
    assert held["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"] == {"set-cookie": ["a=1", "b=2"], "via": "x"}


def test_the_query_returns_text_and_headers(spark, sf):
    rows = queries.op6_warc_derivatives(spark, sf).limit(20).collect()
    for r in rows:
        own = json.loads(r["headers"])
        assert own["WARC-Block-Digest"] == warc.digest(r["block"].encode()) and own["WARC-Refers-To"] == r["refers_to"]
        assert r["record_type"] != "metadata" or json.loads(r["block"])["Envelope"]["WARC-Header-Metadata"]["WARC-Record-ID"] == r["refers_to"]
