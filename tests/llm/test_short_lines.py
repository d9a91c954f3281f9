"""Texts of very short lines: a worker's memory follows the bytes of a batch, and its lines are all there."""

import re
import tracemalloc

import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("latticeflow.llm")
from latticeflow.llm import line_dedup  # noqa: E402


def worker(monkeypatch):
    """The function that a worker runs on a batch of documents."""
    monkeypatch.setattr(line_dedup, "documents", lambda docs, **_: docs)
    monkeypatch.setattr(line_dedup, "map_rows", lambda rows, schema, make: make())
    return line_dedup._doc_lines(None, "doc_id", "text")


def plain(doc_id, text):
    real = [(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate((text or "").split("\n"))]
    key = xxhash.xxh3_128_digest(text or "")
    return [(doc_id, key, k, seq, xxhash.xxh3_128_digest(x), n) for seq, (k, x, n) in enumerate(x for x in real if x[2])]


def test_lines_across_blocks(monkeypatch):
    texts = [None, "", "\n\n", "a\n" * 9000 + "b c\r\n \n\t\nä ö  ü", " x\n\ny " * 20_000, "end", "\n" * 17_000 + "z", "p q\n" * 33_000]
    batch = pa.record_batch({"doc_id": pa.array([5, None, 7, 3, 3, 1, 2, 9], pa.int64()), "text": pa.array(texts)}).slice(1)
    names = ("doc_id", "text_key", "line", "seq", "hash", "words")
    found = [r for x in worker(monkeypatch)(batch) for r in zip(*(pa.array(x[c]).to_pylist() for c in names), strict=True)]
    assert found == [r for d, x in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for r in plain(d, x)]


def test_memory_of_short_lines(monkeypatch):
    batch = pa.record_batch({"doc_id": pa.array(range(100), pa.int64()), "text": pa.array(["a\n" * 3000] * 100)})
    work, n, most = worker(monkeypatch), 0, 0
    tracemalloc.start()
    for x in work(batch):
        n, most = n + len(x["line"]), max(most, len(x["line"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300_000 and most < 20_000
    assert peak < 20 << 20, peak
