"""SimHash groups and repeated line runs against plain versions."""

from collections import Counter

import numpy as np
import pytest

pytest.importorskip("latticeflow.llm")
import xxhash  # noqa: E402

from latticeflow.llm import line_dedup, simhash  # noqa: E402
from latticeflow.llm._common import Scratch  # noqa: E402
from latticeflow.llm.components import components  # noqa: E402

from .cases import empty, odd  # noqa: E402


def plain_fingerprint(text):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_near_duplicates(spark, sf):
    for docs in (odd(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
        fp = [plain_fingerprint(r["text"] or "") for r in rows]
        links = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3]
        root = plain_components(len(fp), links)
        want = Counter((r["doc_id"], f"{fp[k]:016x}", rows[root[k]]["doc_id"]) for k, r in enumerate(rows))
        assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
        kept = simhash.keep_one_of_each(docs)
        assert kept.columns == docs.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(rows[k]["doc_id"] for k in range(len(rows)) if root[k] == k)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one_of_each(empty(spark)).count() == 0


def near_group(seed, bases, near, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, bases, dtype=np.uint64)
    out = set(base.tolist())
    for b in base[: max(1, bases // 8)].tolist():
        for _ in range(near):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, flips)):
                x ^= 1 << int(k)
            out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("crowd", [1024, 4])
def test_links_lose_nothing(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    fp = near_group(crowd, 80, 60, 7)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    want = simhash.forest(i, j, len(fp))
    frame = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = simhash.links(frame).collect()
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    assert all((np.uint64(r["a"] % 2**64) ^ np.uint64(r["b"] % 2**64)) >= 0 for r in edges)
    assert len(edges) <= 2 * 50 * len(fp)
    got = simhash.forest(np.array([at[r["a"]] for r in edges]), np.array([at[r["b"]] for r in edges]), len(fp))
    assert (got == want).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = plain_components(500, edges)
    assert got == {x: root[x] for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def plain_repeated(rows, least):
    """Numbers of removed lines by document, from all runs of all lengths."""
    docs = sorted({(r["doc_id"], r["text"] or "") for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0, xxhash.xxh3_128_digest(d[1])))
    seen, gone = set(), {d: set() for d in docs}
    starts = []
    for d in docs:
        lines = [(k, x, len(x.encode().split())) for k, x in enumerate(d[1].split("\n")) if x.encode().split()]
        starts += [(d, lines, k) for k in range(len(lines))]
    for d, lines, k in starts:
        words, longest = 0, None
        for n in range(1, len(lines) - k + 1):
            words += lines[k + n - 1][2]
            run = tuple(x[1] for x in lines[k : k + n])
            if run in seen and words >= least:
                longest = n
        if longest:
            gone[d] |= {x[0] for x in lines[k : k + longest]}
        for n in range(1, len(lines) - k + 1):
            seen.add(tuple(x[1] for x in lines[k : k + n]))
    return gone


def check_lines(docs, least):
    rows = docs.collect()
    gone = plain_repeated(rows, least)
    want = Counter()
    for r in rows:
        own = gone[r["doc_id"], r["text"] or ""]
        left = None if r["text"] is None else "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in own)
        want[r["doc_id"], left, tuple(sorted(own))] += 1
    out = line_dedup.remove_repeated_lines(docs, min_words=least, removed="went")
    assert out.columns == [*docs.columns, "went"]
    assert Counter((r["doc_id"], r["text"], tuple(r["went"])) for r in out.collect()) == want


def test_repeated_runs_in_tables(spark, sf):
    check_lines(odd(spark), 50)
    check_lines(spark.read.parquet(f"{sf}/documents.parquet"), 50)
    assert line_dedup.remove_repeated_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeated_runs_in_small_alphabets(spark, seed):
    rng = np.random.default_rng(seed)
    lines = ["a", "b b", "c c c", "", "d d d d", "e"]
    rows = [(int(k // 2) if k % 5 else None, "\n".join(lines[x] for x in rng.integers(0, len(lines), rng.integers(0, 14)))) for k in range(14)]
    check_lines(spark.createDataFrame(rows, "doc_id long, text string"), 6)
