"""Benchmark leaks, language identification, licences and WARC derivatives against plain versions."""

import base64
import gzip
import hashlib
import json
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("latticeflow.llm")
from latticeflow.llm import decontaminate, language_id, licenses, templates, warc  # noqa: E402

from .cases import empty, odd  # noqa: E402

SIGNS = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", SIGNS.sub(" ", (text or "").lower())) if w]


def plain_leaks(docs, items, share=0.8, size=5):
    out = Counter()
    parts = lambda w: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    own = [(i, parts(plain_words(t))) for i, t in {*items}]
    for doc, text in docs:
        held = parts(plain_words(text))
        for item, x in own:
            if x and len(x & held) >= share * len(x) - 1e-9:
                out[doc, item, len(x & held), len(x)] += 1
    return out


def check_leaks(docs, benchmark):
    want = plain_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in benchmark.collect() if r["text"] is not None])
    assert Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontaminate.find_leaks(docs, benchmark).collect()) == want
    dirty = Counter(r["doc_id"] for r in docs.collect()) - Counter(r["doc_id"] for r in decontaminate.drop_leaks(docs, benchmark).collect())
    assert {*dirty} == {d for d, *_ in want}
    return want


def test_leaks_in_tables(spark, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert check_leaks(spark.read.parquet(f"{sf}/documents.parquet"), benchmark)
    check_leaks(odd(spark), benchmark)
    assert decontaminate.find_leaks(empty(spark), benchmark).count() == 0
    assert decontaminate.find_leaks(odd(spark), benchmark.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd(spark), benchmark.limit(0)).count() == odd(spark).count()


def test_partial_leaks_in_long_documents(spark, monkeypatch):
    """Items of many sizes with some words changed, within long texts, with blocks of one item or two."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    rng = np.random.default_rng(0)
    word = lambda n, k: [f"{c}{x}" for c, x in zip(rng.choice([*"abc"], n), rng.integers(0, k, n), strict=True)]
    items = [(k, " ".join(word(n, 400))) for k, n in enumerate([3, 5, 6, 9, 17, 33, 40, 64, 90])] + [(50, None), (None, "one two three four five six")]
    docs = [(None, "x " + items[4][1])]
    for k, text in items[:9]:
        for changes in (0, 1, 2, 4):
            own = text.split()
            for at in rng.integers(0, len(own), changes):
                own[at] = "new"
            docs.append((100 * k + changes, ", ".join([*word(3000, 400), *own, *word(2000, 400)]).upper()))
    found = check_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert any(shared < n for _, _, shared, n in found) and len(found) > 12


def test_sketches_have_what_the_bound_needs():
    items = [(k, " ".join(f"w{k}x{j}" for j in range(n))) for k, n in enumerate((5, 9, 30, 200))]
    s = decontaminate.Sketches(items, 0.8)
    held = Counter(s.items.tolist())
    for k, x in enumerate(s.shingles):
        assert held[k] >= min(len(x), int(0.2 * len(x) + 1e-9) + 1)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.predict(docs, language_id.fit(docs)).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 200 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) > 0.98


def test_language_cases(spark):
    docs = odd(spark)
    model = language_id.fit(docs)
    assert model.languages == sorted({r["lang"] for r in docs.collect() if r["lang"] and r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2})
    for r in language_id.predict(docs, model).collect():
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert r["held_out"] is True or r["doc_id"] is not None
    assert language_id.predict(empty(spark), model).count() == 0
    none = language_id.fit(empty(spark))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}


def test_language_scores_equal_plain_naive_bayes(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("Der Hund bellt.", "de"), ("the dog barks", "en"), ("the cat", "en"), ("die Katze", "de")] * 3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(text):
        out = []
        features, bounds, _ = language_id.features(pa.array([text]))
        for order in features:
            out += [g for g in order.tolist() if g < language_id.BUCKETS]
        return out

    trained = {k: Counter() for k in model.languages}
    docs = Counter()
    for k, t, lang in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            trained[lang].update(grams(t))
            docs[lang] += 1
    text = "the hund ß"
    logs = []
    for lang in model.languages:
        total = sum(trained[lang].values()) + 0.5 * language_id.BUCKETS
        logs.append(np.log(docs[lang] / sum(docs.values())) + sum(np.log((trained[lang][g] + 0.5) / total) for g in grams(text)))
    lang, score = model.score(pa.array([text, ""]))
    assert lang == [model.languages[int(np.argmax(logs))], "und"]
    assert score[0] == pytest.approx(np.exp(max(logs)) / np.exp(logs).sum())


def longest(values):
    for n in range(len(values), 0, -1):
        if any(all(a < b for a, b in zip(c, c[1:], strict=False)) for c in combinations(values, n)):
            return n
    return 0


def test_patience():
    rng = np.random.default_rng(0)
    for _ in range(60):
        values = rng.permutation(9)[: rng.integers(0, 9)].tolist()
        places = licenses._increasing(values)
        got = [values[k] for k in places]
        assert got == sorted(got) and places == sorted(places) and len(got) == longest(values)
    for _ in range(200):
        a, b = (rng.choice([*"abcdefgh"], rng.integers(0, 12)).tolist() for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    words = licenses.templates()[0].words
    assert len(licenses.align(words, words)) == len(words)


def test_licenses(spark):
    noise = " ".join(f"noise{k}" for k in range(400))
    mit = templates.MIT.split()
    changed = " ".join("changed" if k % 11 == 5 else w for k, w in enumerate(mit))
    broken = " ".join("changed" if k % 3 == 0 else w for k, w in enumerate(mit))
    texts = {
        1: f"{noise} {templates.MIT} {noise}",
        2: f"{noise}\n// {changed}\n{noise}",
        3: f"{noise} {broken}",
        4: f"{templates.MIT} {noise} {templates.MIT} {noise} {templates.APACHE}",
        5: "Licensed under CC BY-NC 4.0.\nA text.",
        6: "Licensed under the Apache License, Version 2.0.",
        7: "A licence is a permission to do something, for any person, without any charge.",
        8: None,
        9: templates._GPL.format(name="Lesser General Public License", version="2.1"),
        10: f"{templates.TEMPLATES[2][2]} {noise}",
    }
    rows = {r["doc_id"]: r for r in licenses.find_licenses(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert {k: r["license"] for k, r in rows.items()} == {1: "MIT", 2: "MIT", 3: None, 4: "MIT", 5: "CC-BY-NC-4.0", 6: "Apache-2.0", 7: None, 8: None, 9: "LGPL-2.1-or-later", 10: "BSD-3-Clause"}
    assert rows[1]["coverage"] == 1.0 and 0.8 <= rows[2]["coverage"] < 1 and rows[4]["n_licenses"] == 3
    name, start, end = rows[1]["spans"].split(":")
    assert texts[1][int(start) : int(end)] == templates.MIT.rstrip(".")
    assert licenses.find_licenses(odd(spark)).where("license is not null").count() == 0
    assert licenses.find_licenses(empty(spark)).count() == 0


def test_license_candidates_lose_nothing(spark, sf):
    every = licenses.templates()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["n_licenses"] for r in licenses.find_licenses(docs).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == len(licenses.find(plain_words(r["text"]), every))


PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><meta name="k" content='v "x"'><style>p{margin:0}</style>
<script>var t="</p>";track(3);</script></head><body><!-- <p>gone</p> --><p>One <b>two</b>&nbsp;three<br>four</p>
<a title="a>b" href="/x?a=1&amp;b=2">five</a> 1 < 2 <img src=y.png></body></html>"""


def test_extraction():
    text, found = warc.extract(PAGE)
    assert text == "A & B\nOne two three\nfour\nfive 1 < 2"
    assert found == {"title": "A & B", "metas": [{"name": "k", "content": 'v "x"'}], "links": [{"path": "A@/href", "url": "/x?a=1&b=2"}, {"path": "IMG@/src", "url": "y.png"}]}
    assert warc.extract("") == ("", {"title": "", "metas": [], "links": []})
    assert warc.extract("<p>open <!-- never closed <p>x")[0] == "open"
    assert len(warc.extract("<p class=\"" * 20000)[0]) > 0


def test_derivatives(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    responses = warc.responses_from_pages(pages).collect()
    rows = warc.derive(warc.responses_from_pages(pages)).collect()
    by = {(r["refers_to"], r["record_type"]): r for r in rows}
    assert len(rows) == len(by) == 2 * len(responses) == 2 * pages.count()
    assert len({r["record_id"] for r in rows}) == len(rows)
    for r in responses:
        payload = bytes(r["block"]).partition(b"\r\n\r\n")[2]
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        meta, text = by[r["record_id"], "metadata"], by[r["record_id"], "conversion"]
        for x in (meta, text):
            raw = x["block"].encode()
            assert (x["target_uri"], x["warc_date"], x["payload_digest"], x["content_length"]) == (r["target_uri"], r["warc_date"], digest, len(raw))
            assert x["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert x["headers"]["WARC-Refers-To"] == r["record_id"] and x["headers"]["WARC-Type"] == x["record_type"]
        held = json.loads(meta["block"])["Envelope"]
        assert held["WARC-Header-Metadata"] == r["headers"]
        assert held["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]["content-length"] == str(len(payload))
        assert text["block"] == warc.extract(payload.decode())[0] and "<" not in text["block"]
    out = f"file://{tmp_path}/derived"
    warc.write_records(warc.derive(warc.responses_from_pages(pages)), out)
    found = [x for f in tmp_path.glob("derived/part-*") for x in warc.parse_records(f.read_bytes())]
    assert sorted((h["WARC-Record-ID"], b) for h, b in found) == sorted((r["record_id"], r["block"].encode()) for r in rows)


def test_reading_of_files(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\xe9</p>"
    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:uuid:{}>\r\nWARC-Target-URI: http://x.example/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {}\r\n\r\n"
    records = [(head.format(kind, k, len(block)).encode() + block + b"\r\n\r\n") for k, kind in enumerate(("request", "response", "response"))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    rows = warc.derive(warc.read_responses(spark, f"file://{tmp_path}/a.warc.gz")).collect()
    assert [(r["record_type"], r["refers_to"]) for r in rows] == [(t, f"<urn:uuid:{k}>") for k in (1, 2) for t in ("metadata", "conversion")]
    assert {r["block"] for r in rows if r["record_type"] == "conversion"} == {"café"}


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "http://x.example", ""), (2, "u", "no markup"), (2, "u", "no markup"), (3, "u", "<p>" * 5000 + "é" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as block", "'x' as headers", "2 as record_id")
    out = warc.derive(warc.responses_from_pages(pages)).where("record_type = 'conversion'").collect()
    assert Counter(r["block"] for r in out) == Counter({"": 2, "no markup": 2, "é" * 5000: 1})
    assert warc.derive(warc.responses_from_pages(pages.limit(0))).count() == 0
