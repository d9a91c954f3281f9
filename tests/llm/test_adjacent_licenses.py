"""Licence texts close together, against alignments at every start."""

import pytest

pytest.importorskip("latticeflow.llm")
from latticeflow.llm import licenses  # noqa: E402

EVERY = {t.license: t for t in licenses.templates() if t.kind != "line"}


def brute(words, template):
    size, found = len(template.words), []
    for k in range(len(words)):
        pairs = licenses.align(template.words, words[k : k + size + size // 4 + 8])
        if len(pairs) >= template.least * size:
            found.append((-len(pairs), pairs[-1][1] - pairs[0][1], k + pairs[0][1], k + pairs[-1][1] + 1))
    kept = []
    for _, _, s, e in sorted(found):
        if all(e <= a or b <= s for a, b in kept):
            kept.append((s, e))
    return sorted(kept)


@pytest.mark.parametrize("before", [0, 48, 100, 211])
@pytest.mark.parametrize("copies", [2, 3])
def test_adjacent_copies(before, copies):
    mit = EVERY["MIT"]
    damaged = ["changed" if k % 9 == 4 else w for k, w in enumerate(mit.words)]
    for text in (mit.words, damaged):
        words = [f"noise{k}" for k in range(before)] + text * copies + ["end"] * 30
        got = [(s, e) for _, _, s, e in licenses.find(words, [mit])]
        assert got == brute(words, mit) and len(got) == copies


def test_adjacent_copies_of_every_text(spark):
    rows = [(k, "\n\n".join([text] * 2)) for k, (_, kind, text) in enumerate(licenses.TEMPLATES) if kind != "line"]
    got = {r["doc_id"]: r["n_licenses"] for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 2 for k, _ in rows}
