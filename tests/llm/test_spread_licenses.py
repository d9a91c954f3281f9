"""Licences with foreign words in them, against the alignment of whole texts."""

import numpy as np
import pytest

pytest.importorskip("latticeflow.llm")
from latticeflow.llm import licenses, templates  # noqa: E402

EVERY = licenses.templates()
MIT = next(t for t in EVERY if t.license == "MIT" and t.kind != "line")


@pytest.mark.parametrize("n", [0, 50, 250, 300, 600, 1500, 5000])
@pytest.mark.parametrize("where", ["one place", "spread", "before and after"])
def test_any_number_of_foreign_words(n, where):
    rng = np.random.default_rng(n)
    foreign = [f"foreign{x}" for x in rng.integers(0, 10**6, n)]
    own = [*MIT.words]
    if where == "one place":
        words = own[:80] + foreign + own[80:]
    elif where == "spread":
        at = np.sort(rng.integers(0, len(own) + 1, n))
        words = [w for k in range(len(own) + 1) for w in (*[f for f, a in zip(foreign, at, strict=True) if a == k], *own[k : k + 1])]
    else:
        words = foreign + own[:60] + foreign + own[60:] + foreign
    found = licenses.find(words, EVERY)
    assert [name for name, *_ in found] == ["MIT"] and found[0][1] >= 0.8
    assert found[0][3] - found[0][2] >= 0.8 * len(own)


@pytest.mark.parametrize("seed", range(6))
def test_no_match_of_whole_texts_is_lost(seed):
    """Templates with words lost, added and moved, in texts that use the templates' own words too."""
    rng = np.random.default_rng(seed)
    pool = sorted({w for t in EVERY for w in t.words})
    for _ in range(12):
        t = EVERY[rng.integers(0, len(EVERY))]
        words = [w for w in t.words for w in ([w] if rng.random() > 0.12 else [])]
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(words) + 1)
            words[at:at] = rng.choice(pool, rng.integers(0, 700)).tolist()
        for x in EVERY:
            if x.kind != "line":
                pairs = licenses.align(x.words, words)
                if len(pairs) >= x.least * len(x.words) - 1e-9:
                    assert licenses.scan(words, x)


def test_lines_of_templates(spark):
    text = " ".join(MIT.words[:100]) + " and " + "so on " * 1000 + " ".join(MIT.words[100:])
    row = licenses.find_licenses(spark.createDataFrame([(1, text), (2, templates.MIT)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in row} == {1: "MIT", 2: "MIT"}
