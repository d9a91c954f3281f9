"""Short test items, other column names, and benchmarks of several blocks."""

from collections import Counter

import numpy as np
import pytest

pytest.importorskip("latticeflow.llm")
from latticeflow.llm import decontaminate  # noqa: E402

from .test_search import plain_words  # noqa: E402


def plain(docs, items):
    """Whole items of one to four words, as runs of words."""
    out = Counter()
    for doc, text in docs:
        words = plain_words(text)
        for item, own in {*items}:
            own = plain_words(own)
            if 0 < len(own) < 5 and any(words[k : k + len(own)] == own for k in range(len(words))):
                out[doc, item, 1, 1] += 1
    return out


def test_short_items(spark):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(rng.choice([*"abcdefgh"], n))
    items = [(k, text(n)) for k, n in enumerate([1, 2, 3, 4] * 5)] + [(90, ""), (91, "?!"), (92, "日本語の一文。"), (93, None), (None, "A, b")]
    docs = [(k, text(n)) for k, n in enumerate([0, 1, 2, 3, 7, 30, 200])] + [(50, "x 日本語の一文。 y"), (51, None), (None, "a b")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, [x for x in items if x[1]])
    assert Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontaminate.find_leaks(d, b, short=True).collect()) == want
    kept = Counter(r["doc_id"] for r in decontaminate.drop_leaks(d, b, short=True).collect())
    assert kept == Counter(x for x, _ in docs) - Counter({x for x, *_ in want})
    assert decontaminate.find_leaks(d, b).count() == 0


def test_one_text_under_many_ids_in_blocks(spark, monkeypatch):
    """A block holds so many bytes of texts and ids, whatever repeats."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    text = "one two three four five six seven"
    b = spark.createDataFrame([(k, text) for k in range(400)], "item_id long, text string")
    sizes = [len(x.ids) for x in decontaminate.blocks(b, 0.8)]
    assert sum(sizes) == 400 and max(sizes) < 2.5 * 2000 / len(text)
    docs = spark.createDataFrame([(1, "zero " + text)], "doc_id long, text string")
    assert decontaminate.find_leaks(docs, b).count() == 400


def test_other_column_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "other words")], "id long, body string")
    for name in ("text", "body"):
        b = spark.createDataFrame([(7, "two three four five six")], f"item_id long, {name} string")
        assert [r["doc_id"] for r in decontaminate.find_leaks(docs, b, id_col="id", text_col="body").collect()] == [1]
        assert [r["id"] for r in decontaminate.drop_leaks(docs, b, text_col="body").collect()] == [2]
    b = spark.createDataFrame([(7, "two three four five six")], "item_id long, question string")
    assert [r["id"] for r in decontaminate.drop_leaks(docs, b, text_col="body", item_text_col="question").collect()] == [2]
