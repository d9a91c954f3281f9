"""Files with faults in them, and extraction against the standard library's parser."""

import gzip
import html.parser
import json
import re

import pytest

pytest.importorskip("latticeflow.llm")
from latticeflow.llm import warc  # noqa: E402


def record(name, block, length=None, kind="response", version="1.0", end="\r\n"):
    size = len(block) if length is None else length
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Target-URI: http://x.example/", *([f"Content-Length: {size}"] if size != "" else [])]
    return end.join([*head, "", ""]).encode() + block + (end * 2).encode()


PAGE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>text %d</p>"
CASES = {
    "plain": ([record("a", PAGE % 1), record("b", PAGE % 2)], [("a", PAGE % 1, False), ("b", PAGE % 2, False)]),
    "lower case": ([record("a", PAGE % 1).replace(b"WARC-", b"warc-").replace(b"Content-Length", b"content-length"), record("b", PAGE % 2)], [("a", PAGE % 1, False), ("b", PAGE % 2, False)]),
    "no number": ([record("a", PAGE % 1, "many"), record("b", PAGE % 2)], [("a", PAGE % 1, False), ("b", PAGE % 2, False)]),
    "no length": ([record("a", PAGE % 1, ""), record("b", PAGE % 2)], [("a", PAGE % 1, False), ("b", PAGE % 2, False)]),
    "cut block": ([record("a", PAGE % 1), record("b", PAGE % 2)[:-20]], [("a", PAGE % 1, False), ("b", (PAGE % 2)[:-16], True)]),
    "cut head": ([record("a", PAGE % 1), record("b", PAGE % 2)[:60]], [("a", PAGE % 1, False), ("b", b"", True)]),
    "too long": ([record("a", PAGE % 1, 10**6)], [("a", PAGE % 1 + b"\r\n\r\n", True)]),
    "junk": ([b"no record\r\n", record("a", PAGE % 1), b"WARC/ junk\r\n\r\n", record("b", PAGE % 2)], [("a", PAGE % 1, False), ("b", PAGE % 2, False)]),
    "mark in block": ([record("a", PAGE % 1 + b"\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nx WARC/1.1"), record("b", PAGE % 2)], [("a", PAGE % 1 + b"\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nx WARC/1.1", False), ("b", PAGE % 2, False)]),
    "mark in head": ([record("a", PAGE % 1).replace(b"WARC-Target", b"Software: WARC/1.0\r\nWARC-Target"), record("b", PAGE % 2)], [("a", PAGE % 1, False), ("b", PAGE % 2, False)]),
    "bare line ends": ([record("a", PAGE % 1, end="\n"), record("b", PAGE % 2, version="1.1")], [("a", PAGE % 1, False), ("b", PAGE % 2, False)]),
    "not text": ([record("a", bytes(range(256)) * 9), record("w", b"x", kind="warcinfo")], [("a", bytes(range(256)) * 9, False)]),
    "repeated": ([record("a", PAGE % 1)] * 2, [("a", PAGE % 1, False)] * 2),
    "empty": ([], []),
}


@pytest.mark.parametrize("case", CASES)
def test_faults(case):
    parts, want = CASES[case]
    for data in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        found = [(h["WARC-Record-ID"].strip("<>"), b, "WARC-Truncated" in h) for h, b in warc.parse_records(data) if h.get("WARC-Type") == "response"]
        assert found == want


def test_files_in_splits(spark, tmp_path):
    """All cases as files, plain in small splits and compressed."""
    want = []
    for k, (parts, rows) in enumerate(CASES.values()):
        name = f"{k}.warc" if k % 2 and "mark" not in [*CASES][k] else f"{k}.warc.gz"
        (tmp_path / name).write_bytes(b"".join(parts) if name.endswith("c") else b"".join(map(gzip.compress, parts)))
        want += [(f"<{n}>", b, cut) for n, b, cut in rows]
    many = [record(f"m{k}", PAGE % k) for k in range(3000)]
    (tmp_path / "many.warc").write_bytes(b"".join(many))
    want += [(f"<m{k}>", PAGE % k, False) for k in range(3000)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = warc.read_responses(spark, f"file://{tmp_path}")
        assert frame.rdd.getNumPartitions() > 10
        rows = frame.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["record_id"], bytes(r["block"]), "WARC-Truncated" in r["headers"]) for r in rows) == sorted(want)
    assert warc.derive(warc.read_responses(spark, f"file://{tmp_path}")).count() == 2 * len(want)


def test_broken_gzip(spark, tmp_path):
    parts = [record(f"r{k}", PAGE % k + bytes(range(256)) * 40) for k in range(40)]
    data = b"".join(map(gzip.compress, parts))
    (tmp_path / "a.warc.gz").write_bytes(data[: len(data) * 3 // 4])
    found = [*warc.parse_records(data[: len(data) * 3 // 4])]
    assert 28 <= len(found) <= 32 and "WARC-Truncated" in found[-1][0] and all("WARC-Truncated" not in h for h, _ in found[:-1])
    assert warc.read_responses(spark, f"file://{tmp_path}", skip_broken_files=True).count() >= 20


class Plain(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "template", "noscript", "svg")
        self.out += ["\n"] * (tag in warc._BLOCKS)

    def handle_startendtag(self, tag, attrs):
        self.out += ["\n"] * (tag in warc._BLOCKS)

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "template", "noscript", "svg") and self.skip > 0
        self.out += ["\n"] * (tag in warc._BLOCKS)

    def handle_data(self, data):
        self.out += [data] * (not self.skip)


def test_text_equals_that_of_the_standard_parser(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parser = Plain()
        parser.feed(r["html"])
        parser.close()
        want = re.sub(r"\s*\n\s*", "\n", re.sub(r"[^\S\n]+", " ", "".join(parser.out))).strip()
        assert warc.extract(r["html"])[0] == want


def test_headers_of_any_case(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(CASES["lower case"][0][0])
    rows = warc.derive(warc.read_responses(spark, f"file://{tmp_path}")).collect()
    assert {r["target_uri"] for r in rows} == {"http://x.example/"} and {r["refers_to"] for r in rows} == {"<a>"}
    meta = next(json.loads(r["block"]) for r in rows if r["record_type"] == "metadata")
    assert meta["Envelope"]["WARC-Header-Metadata"]["WARC-Type"] == "response"
