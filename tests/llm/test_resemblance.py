"""Links of resembling texts against all pairs."""

import numpy as np
import pytest

pytest.importorskip("latticeflow.llm")
import corpus_pipeline  # noqa: E402
from latticeflow.llm import simhash  # noqa: E402

from .cases import empty, odd  # noqa: E402
from .test_groups import plain_components, plain_fingerprint  # noqa: E402


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets, fp = [plain_set(t) for _, t in rows], [plain_fingerprint(t or "") for _, t in rows]
    near = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    links = [(a, b) for a in range(len(rows)) for b in range(a) if near(a, b)]
    far = sum((fp[a] ^ fp[b]).bit_count() > 3 for a, b in links)
    root = plain_components(len(rows), links)
    return sorted(rows[k][0] for k in range(len(rows)) if root[k] == k), far


def varied(seed):
    """Groups of texts around the bound, with chains whose ends don't resemble each other."""
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(3, 160))]
        for _ in range(10):
            own = [*words]
            for at in rng.integers(0, len(own), rng.integers(0, 1 + len(own) // 30 + group % 3)):
                own[at] = f"x{rng.integers(0, 10**6)}"
            rows.append(" ".join(own))
            words = own if rng.random() < 0.5 else words  # the next one may go on from this one
    return [*enumerate(rng.permutation(rows).tolist())]


@pytest.mark.parametrize("seed", range(2))
def test_all_resembling_pairs_are_linked(spark, seed):
    rows = varied(seed)
    want, far = plain_kept(rows)
    assert far > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs, similarity=0.8).collect()) == want
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == want


def test_tables_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, _ = plain_kept(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()) == want
    kept = corpus_pipeline.near_copies(spark, odd(spark), sf)
    assert kept.columns == odd(spark).columns
    assert sorted(kept.collect(), key=str) == sorted(simhash.keep_one_of_each(odd(spark)).collect(), key=str)
    assert corpus_pipeline.near_copies(spark, empty(spark), sf).count() == 0
