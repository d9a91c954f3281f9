"""Token counts, quality rules, personal data and packing against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("latticeflow.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from latticeflow.llm import packing, pii, quality, queries, token_counts  # noqa: E402
from latticeflow.llm._common import Scratch  # noqa: E402

from .cases import ODD, empty, odd  # noqa: E402

SOME = st.text(st.sampled_from("aábcdZÉßñ 'sİΣς  \n\t\r▁́\u0085中ё,.!%$|<>0123½ºª\x00\x1c😀"), max_size=40)


@pytest.mark.parametrize("make", [queries.piece_model, queries.word_model])
def test_encoders_equal_the_libraries(make):
    encoder = make().load()

    @settings(max_examples=200, deadline=None)
    @given(st.lists(SOME, min_size=1, max_size=6))
    def check(texts):
        ids, offsets = encoder.encode_all(pa.array([*texts, "the quick <|endoftext|> <s>", ""]))
        for k, x in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == encoder.whole(x).tolist()

    check()


def test_token_counts(spark, sf):
    library = queries.piece_model().load().library
    for docs in (odd(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, queries.piece_model(), f"{Scratch(spark, 't').root}/c").collect())
        want = []
        for r in docs.collect():
            n = len(library.encode(r["text"] or ""))
            want.append((r["doc_id"] or -1, len((r["text"] or "").encode()), n, n > 4096))
        assert got == sorted(want)


def test_token_cache_encodes_only_what_is_missing(spark):
    cache = f"{Scratch(spark, 't').root}/c"
    model = queries.piece_model()
    first = token_counts.count_tokens(odd(spark).limit(4), model, cache)
    n = token_counts.stored(first, cache, model.version).count()
    token_counts.count_tokens(odd(spark), model, cache).collect()
    token_counts.count_tokens(odd(spark), model, cache).collect()
    kept = token_counts.stored(first, cache, model.version)
    assert n < kept.count() == len({x[1] or "" for x in ODD})
    other = queries.word_model()
    assert token_counts.stored(first, cache, other.version).count() == 0
    assert token_counts.count_tokens(empty(spark), model, cache).count() == 0


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    covered = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality(spark, sf):
    for docs in (odd(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        got = sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.score_quality(docs, queries.piece_model()).collect())
        rows = docs.collect()
        assert got == sorted((r["doc_id"] or -1, *plain_quality(r["text"] or "")) for r in rows)
        kept = Counter(r["doc_id"] for r in quality.score_quality(docs, queries.piece_model()).where("kept").collect())
        assert Counter(r["doc_id"] for r in quality.keep_quality(docs, queries.piece_model()).collect()) == kept
    assert quality.score_quality(empty(spark), queries.piece_model()).count() == 0


def test_fertility_verdict(spark, sf):
    encoder = queries.piece_model().load()
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = [r["text"] or "" for r in rows]
    got = quality.judge(pa.array(texts), [r["lang"] for r in rows], encoder)
    for k, text in enumerate(texts):
        ids = encoder.library.encode(text)
        n = len(ids)
        p = np.array([*Counter(ids).values()]) / max(n, 1)
        entropy = -(p * np.log2(p)).sum() if n else 0
        band = quality.LANGUAGES.get(rows[k]["lang"], quality.SCRIPTS["Latin"])
        ok = entropy >= min(band.entropy_share * np.log2(max(n, 1)), band.entropy)
        if n >= band.least:
            ok &= band.chars_per_token[0] <= len(text) / n <= band.chars_per_token[1] and sum(encoder.is_byte[i] for i in ids) / n <= band.byte_share
        assert abs(got["entropy"][k] - entropy) < 1e-5
        assert got["kept"][k] == (ok and not plain_quality(text)[-1])


def test_labelled_good_documents_stay(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id").distinct()
    judged = quality.score_quality(docs, queries.piece_model()).where("n_words >= 20").join(good, "doc_id").collect()
    assert sum(r["kept"] for r in judged) >= 0.99 * len(judged)


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("ab@@..-+%_ 0123456789(ü\n"), max_size=40))
def test_base_spans(text):
    base, every = pii.find(text, AUTOMATON)
    assert base == plain_spans(text)
    assert set(base) <= set(every)


AUTOMATON = pii._automaton()


def test_added_spans():
    kinds = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find(t, AUTOMATON)[1] if k > 3]
    assert kinds("mail jörg@müller.de now") == [("mailbox", "jörg@müller.de")]
    assert kinds("see https://user:pw@host.example/x.") == [("address", "https://user:pw@host.example/x")]
    assert kinds("at http://[2001:db8::1]:80/a, or http://site.example/") == [("address", "http://[2001:db8::1]:80/a")]
    assert kinds("IBAN: GB82 WEST 1234 5698 7654 32 then") == [("account", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("IBAN GB83 WEST 1234 5698 7654 32") == []
    assert kinds("SSN 123-45-6789.") == [("account", "123-45-6789")]
    assert kinds("plain text about a passport and an account") == []


def test_personal_data_rows(spark, sf):
    for docs in (odd(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        got = sorted((r["doc_id"] or -1, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.find_personal_data(docs).collect())
        want = []
        for r in docs.collect():
            spans = plain_spans(r["text"] or "")
            text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
            want.append((r["doc_id"] or -1, *(sum(k == x for _, k, _ in spans) for x in range(4)), hashlib.sha256(text.encode()).hexdigest()))
        assert got == sorted(want)
    assert pii.find_personal_data(empty(spark)).count() == 0


def check_packing(rows, docs, capacity):
    library = queries.word_model().load().library
    want = Counter()
    for r in docs:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want[r["doc_id"], p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_packing(spark, sf):
    for docs in (odd(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = packing.pack(docs, queries.word_model()).collect()
        n = check_packing(rows, docs.collect(), 2048)
        assert n == best_fit([r["length"] for r in rows], 2048)
    assert packing.pack(empty(spark), queries.word_model()).count() == 0


def test_frequent_lengths_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 3)
    docs = spark.createDataFrame([(k, "same words here " * (1 + k % 3)) for k in range(60)], "doc_id long, text string")
    rows = packing.pack(docs, queries.word_model(), capacity=16).collect()
    assert check_packing(rows, docs.collect(), 16) == best_fit([r["length"] for r in rows], 16)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_equals_best_fit_over_pieces(counts):
    runs = packing.plan(counts, 30)
    places = defaultdict(list)
    for length, rank, n, first, offset in runs.tolist():
        for j in range(n):
            places[first + j].append((offset, length))
    assert {k: sum(n for length, _, n, _, _ in runs.tolist() if length == k) for k in counts} == counts
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 30
    assert len(places) == best_fit([k for k, n in counts.items() for _ in range(n)], 30)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "a@b.cd " * 30_000, "@" * 200_000, "http://" * 40_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "ü@" * 100_000, "ssn iban " * 30_000):
        base, every = pii.find(text, AUTOMATON)
        assert len(base) <= len(every)
    assert [(pii.KINDS[k], s, e) for s, k, e in pii.find("http://a.example/?u=http://u:p@b.example/c.", AUTOMATON)[1]] == [("address", 20, 42), ("email", 29, 40)]
